"""SQL expressions on time that do not depend on the session time zone."""

from __future__ import annotations

PAIR_TOLERANCE = "INTERVAL '2' SECOND"  # companions lie at most this far apart

# Stands in for an unparsable time in sort orders, so that such rows come last.
END_OF_TIME = "TIMESTAMP_NTZ '9999-12-31 23:59:59'"


def parsed_time(text: str) -> str:
    """`yyyy-MM-ddTHH:mm:ssZ` as TIMESTAMP_NTZ; any other text gives NULL instead of an error."""
    return (
        f"CASE WHEN length({text}) = 20 AND endswith({text}, 'Z') AND substr({text}, 11, 1) = 'T' "
        f"THEN try_cast({text} AS timestamp_ntz) END"
    )


def time_text(time: str) -> str:
    """ISO text with explicit UTC offset, for sinks."""
    return f"date_format({time}, \"yyyy-MM-dd'T'HH:mm:ss'+00:00'\")"


def close_in_time(left: str, right: str) -> str:
    return f"{left} BETWEEN {right} - {PAIR_TOLERANCE} AND {right} + {PAIR_TOLERANCE}"


def epoch_micros(time: str) -> str:
    """Microseconds since 1970 of a TIMESTAMP_NTZ."""
    minutes = f"unix_date(to_date({time})) * 1440L + hour({time}) * 60 + minute({time})"
    return f"({minutes}) * 60000000L + CAST(date_part('SECOND', {time}) * 1000000 AS bigint)"


def hours(micros: str) -> str:
    return f"({micros}) / 3.6e9D"
