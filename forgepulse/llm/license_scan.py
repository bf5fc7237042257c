"""License scan by ordered signature rules, with built-in functions only.

A text is normalised once: A-Z lower-cased, words of letters, digits and characters beyond ASCII, one
space between them. A keyword filter then picks the rules that can match at all, so a text without any
keyword runs no regular expression. Each rule's matches are read off a copy of the text that it has
marked: words that start or end a match carry a mark, and their index is the place.

Detections may overlap. Ordered by start, then longest first, then tier, then rule, one pass drops each
detection whose interval lies within another one of a stronger tier, or of the same tier and longer (or
equal and of an earlier rule). Partial overlaps stay. All of a row's work is within the row: nothing
is shuffled, no row is needed twice.

Cases: a null text counts as empty, an empty one has no words and no detections; texts of any length
are scanned whole (the sweep goes by slices, so many detections don't cost their square);
repeated rows are scanned each; an empty table gives an empty result; input columns named like a
result column are replaced, others are kept whatever their names.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from forgepulse.llm.common import table
from forgepulse.llm.license_rules import RULES, TIERS, Rule

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
START, END = "\x01", "\x02"
"""Marks; as separators they can't occur in normalised text."""

SLICE = 256
SPAN = "struct<start:int,past:int,tier:int,rule:int>"
"""A detection: index of its first word and of the word after its last, with its rule."""

CONFIDENCE = (1.0, 0.9, 0.7, 0.4)
"""Of a document whose strongest detection has this tier."""


def normalised(text: Column) -> Column:
    """A space, then each word with a space behind it."""
    lower = F.translate(F.coalesce(text, F.lit("")), _UPPER, _LOWER)
    return F.regexp_replace(F.concat(F.lit(" "), lower, F.lit(" ")), SEPARATORS, " ")


def _literals(values: Sequence, kind: str = "string") -> Column:
    """A constant array; as one string that is split, it is two nodes of the plan, not hundreds."""
    return F.split(F.lit("\n".join(map(str, values))), "\n").cast(f"array<{kind}>")


def _matching(text: Column, rules: Sequence[Rule]) -> Column:
    """Indexes of the rules that match, by way of the keywords that occur."""
    by_keyword = defaultdict(list)
    for i, rule in enumerate(rules):
        by_keyword[rule.keyword].append(i)
    words = _literals(list(by_keyword))
    members = _literals([",".join(map(str, m)) for m in by_keyword.values()])
    bounded = _literals([f"(?<= )(?:{rule.regex})(?= )" for rule in rules])
    found = F.filter(
        F.sequence(F.lit(0), F.lit(len(by_keyword) - 1)),
        lambda k: F.contains(text, F.get(words, k)),
    )
    return F.flatten(
        F.transform(
            found,
            lambda k: F.filter(
                F.split(F.get(members, k), ",").cast("array<int>"),
                lambda i: F.regexp_like(text, F.get(bounded, i))
            ),
        )
    )


def _spans(text: Column, rule: Column, rules: Sequence[Rule]) -> Column:
    """All places of one rule, from left to right."""
    bounded = _literals([f"(?<= )(?:{r.regex})(?= )" for r in rules])
    marked = F.regexp_replace(text, F.get(bounded, rule), F.lit(f"{START}$0{END}"))
    words = F.split(F.trim(marked), " ")

    def places(mark_of) -> Column:
        # A word's index where it is marked; in order, so starts and ends belong together.
        return lambda held: F.array_compact(
            F.transform(held, lambda w, i: F.when(mark_of(w), i))
        )

    starts = places(lambda w: F.startswith(w, F.lit(START)))
    ends = places(lambda w: F.endswith(w, F.lit(END)))
    tier = F.get(_literals([r.tier for r in rules], "int"), rule)
    paired = F.transform(
        F.array(words),  # binds the split words to a name
        lambda held: F.transform(
            F.arrays_zip(starts(held).alias("s"), ends(held).alias("e")),
            lambda p: F.struct(
                p["s"].cast("int").alias("start"),
                (p["e"] + 1).cast("int").alias("past"),
                tier.alias("tier"),
                rule.alias("rule"),
            ),
        ),
    )
    return F.flatten(paired).cast(f"array<{SPAN}>")


def _pieces(ordered: Column) -> Column:
    """Detections in sweep order, cut into slices; an empty array is one empty slice."""
    last = F.floor(F.greatest(F.size(ordered) - 1, F.lit(0)) / SLICE).cast("int")
    return F.transform(
        F.sequence(F.lit(0), last), lambda c: F.slice(ordered, c * SLICE + 1, SLICE)
    )


def _furthest(piece: Column) -> Column:
    """By tier: the furthest end of a slice's detections of that tier or a stronger one."""

    def end(t: int) -> Column:
        own = F.filter(piece, lambda d: d["tier"] <= t)
        return F.coalesce(F.array_max(F.transform(own, lambda d: d["past"])), F.lit(-1))

    return F.array(*map(end, TIERS))


def _survivors(pieces: Column, ends: Column) -> Column:
    """Detections that lie in none before them in the sweep that is at least as strong.

    What starts later, or at the same word and ends sooner, can't contain a detection. Ends of whole
    slices stand for all earlier slices; within a slice, detections are compared with those before.
    """

    def alone(piece: Column, c: Column) -> Column:
        def reached(t: int) -> Column:
            earlier = F.slice(ends, 1, c)
            return F.aggregate(earlier, F.lit(-1), lambda far, e: F.greatest(far, e[t]))

        before = F.array(*map(reached, TIERS))
        return F.flatten(
            F.transform(
                F.array(before),  # binds what was computed once for the slice to a name
                lambda far: F.filter(
                    piece,
                    lambda d, i: (F.get(far, d["tier"]) < d["past"])
                    & ~F.exists(
                        F.slice(piece, 1, i),
                        lambda e: (e["tier"] <= d["tier"]) & (e["past"] >= d["past"]),
                    ),
                ),
            )
        )

    return F.flatten(F.transform(pieces, alone))


def scan(df: DataFrame, text: str = "text", rules: Sequence[Rule] = RULES) -> DataFrame:
    """`df` with `n_words`, `detections` (all) and `licenses` (those that survive).

    Both are arrays of `start`, `past` (in words from 0), `tier` and `rule` (index in `rules`).
    """
    added = ("n_words", "detections", "licenses")
    others = [c for c in df.columns if c.lower() not in added or c == text]
    kept = F.struct(*[F.col(f"`{c}`") for c in others])
    held = df.select(kept.alias("row"), normalised(F.col(f"`{text}`")).alias("norm"))
    norm = F.col("norm")
    spaces = F.octet_length(norm) - F.octet_length(F.replace(norm, F.lit(" "), F.lit("")))
    found = held.select(
        "row",
        (spaces - 1).cast("long").alias("n_words"),
        F.flatten(F.transform(_matching(norm, rules), lambda i: _spans(norm, i, rules))).alias(
            "detections"
        ),
    )
    in_order = F.transform(
        F.array_sort(
            F.transform(
                "detections",
                lambda d: F.struct(d["start"], (-d["past"]).alias("past"), d["tier"], d["rule"]),
            )
        ),
        lambda d: F.struct(d["start"], (-d["past"]).alias("past"), d["tier"], d["rule"]),
    ).cast(f"array<{SPAN}>")
    cut = found.withColumn("detections", in_order).withColumn("pieces", _pieces(F.col("detections")))
    swept = cut.withColumn("ends", F.transform("pieces", _furthest))
    done = swept.withColumn("licenses", _survivors(F.col("pieces"), F.col("ends")))
    keep = [c for c in others if c.lower() not in added]
    return done.select(*[F.col(f"row.`{c}`").alias(c) for c in keep], *added)


def labels_of(spans: Column, rules: Sequence[Rule] = RULES) -> Column:
    """The distinct labels of detections, sorted, joined by commas."""
    names = _literals([r.label for r in rules])
    found = F.array_distinct(F.transform(spans, lambda d: F.get(names, d["rule"])))
    return F.array_join(F.array_sort(found), ",")


def op12_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Places of the base phrases and labels of every document."""
    scanned = scan(table(spark, sf_dir, "documents").select("doc_id", "text"))
    base_rules = [i for i, rule in enumerate(RULES) if rule.base]
    base = F.filter("detections", lambda d: d["rule"].isin(base_rules))
    strongest = F.array_min(F.transform("licenses", lambda d: d["tier"]))
    narrowed = scanned.select(
        "doc_id", "n_words", "licenses", base.alias("base"), strongest.alias("strongest")
    )
    return narrowed.select(
        "doc_id",
        "n_words",
        F.size("base").cast("long").alias("n_base"),
        F.array_min("base.start").cast("long").alias("first_word"),
        F.array_max("base.start").cast("long").alias("last_word"),
        labels_of(F.col("base")).alias("base_labels"),
        labels_of(F.concat("base", "licenses")).alias("labels"),
        F.coalesce(F.get(_literals(CONFIDENCE, "double"), F.col("strongest")), F.lit(0.0)).alias("score"),
    )


def op12_sql() -> str:
    """Each rule on each text that has its keyword; suppression as an anti-join of intervals.

    Words stand two spaces apart here, so that matches of neighbouring words don't share a space.
    """
    values = ",\n".join(
        f"({i}, '{r.label}', {r.tier}, {r.base}, '{r.keyword.replace(' ', '  ')}', "
        f"'{r.regex.replace(' ', '  ')}')"
        for i, r in enumerate(RULES)
    )
    return f"""
WITH rules(rule, label, tier, base, keyword, rx) AS (VALUES {values}),
texts AS (
  SELECT row_number() OVER () AS row_no, doc_id, regexp_replace('  ' ||
           translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}') || '  ',
           '{SEPARATORS}', '  ', 'g') AS norm
  FROM documents),
marked AS (
  SELECT row_no, rule, label, tier, base, string_split(regexp_replace(norm, ' (' || rx || ') ',
           ' ' || chr(1) || '\\1' || chr(2) || ' ', 'g'), '  ')[2:] AS words
  FROM texts JOIN rules ON contains(norm, keyword)),
spans AS (
  SELECT row_no, rule, label, tier, base, unnest(list_filter(
      list_transform(words, lambda w, i: CASE WHEN starts_with(w, chr(1)) THEN i - 1 END),
      lambda i: i IS NOT NULL)) AS start,
    unnest(list_filter(
      list_transform(words, lambda w, i: CASE WHEN ends_with(w, chr(2)) THEN i END),
      lambda i: i IS NOT NULL)) AS past
  FROM marked),
kept AS (
  SELECT * FROM spans d WHERE NOT EXISTS (
    SELECT 1 FROM spans e
    WHERE e.row_no = d.row_no AND e.start <= d.start AND e.past >= d.past
      AND (e.tier < d.tier OR e.tier = d.tier AND (e.past - e.start > d.past - d.start
           OR e.past - e.start = d.past - d.start AND e.rule < d.rule)))),
base AS (
  SELECT row_no, count(*) AS n_base, min(start) AS first_word, max(start) AS last_word,
         string_agg(DISTINCT label, ',' ORDER BY label) AS base_labels
  FROM spans WHERE base GROUP BY row_no),
every AS (
  SELECT row_no, string_agg(DISTINCT label, ',' ORDER BY label) AS labels
  FROM (SELECT row_no, label FROM kept UNION ALL SELECT row_no, label FROM spans WHERE base)
  GROUP BY row_no),
best AS (SELECT row_no, min(tier) AS strongest FROM kept GROUP BY row_no)
SELECT doc_id, (len(string_split(norm, '  ')) - 2)::BIGINT AS n_words,
       coalesce(n_base, 0)::BIGINT AS n_base, first_word::BIGINT AS first_word,
       last_word::BIGINT AS last_word, coalesce(base_labels, '') AS base_labels,
       coalesce(labels, '') AS labels,
       coalesce(([{', '.join(map(str, CONFIDENCE))}]::DOUBLE[])[strongest + 1], 0.0) AS score
FROM texts LEFT JOIN base USING (row_no) LEFT JOIN every USING (row_no)
LEFT JOIN best USING (row_no)
"""
