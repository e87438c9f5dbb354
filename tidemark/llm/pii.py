"""Personal data by bootstrapped contextual extraction, with DataFrame and SQL operations only.

Matches of the base patterns are seed entities.  The words around them become lexical patterns
(left word, right word, both).  A pattern is scored by the distinct identifiers it stands beside:
how many are known entities of one kind.  Identifier-like strings that stand in high-confidence
patterns become entities themselves, wherever they occur, and support further patterns; rounds end
when nothing new is found.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import quoted, saved, without

KINDS = ("email", "ip", "card", "phone")
SUPPORT = 3  # distinct known entities behind a pattern
CONFIDENCE = 0.8  # least share of them among the identifiers beside the pattern
CONTEXT = 64  # code points looked at on either side

# The base patterns, written so that one scan is linear: what cannot be given back is possessive,
# and a match starts only where the scan of a run can start.
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++(?:\.[0-9]++){3}",
    "card": r"(?<![0-9])(?<![0-9][\x20-])[0-9](?:[\x20-]?[0-9]){12,18}+(?![\x20-]?[0-9])",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
HINT = {"email": "@", "phone": "+"}
# A string that may be an identifier: a word with a digit in it.
CANDIDATE = r"(?<!\S)[^\s0-9]*+[0-9]\S*+"
CANDIDATE_DIGITS = 4

VALID = {
    "email": "true",
    "ip": "forall(split(v, '[.]'), p -> coalesce(try_cast(concat('0', ltrim('0', p)) as int), 256) <= 255)",
    "card": "luhn_check(regexp_replace(v, '[^0-9]', ''))",
    "phone": "length(regexp_replace(v, '[^0-9]', '')) between 9 and 15",
}


def spans(matches: str, between: str) -> Column:
    """Array of (start, end, v) in code points from matches and the stretches around them."""
    return F.expr(
        f"aggregate(sequence(1, size({matches})), named_struct('at', 0, 'out', cast(array() as array<struct<start:int,end:int,v:string>>)),"
        f" (a, i) -> named_struct('at', a.at + char_length({between}[i - 1]) + char_length({matches}[i - 1]), 'out',"
        f" array_append(a.out, named_struct('start', a.at + char_length({between}[i - 1]),"
        f" 'end', a.at + char_length({between}[i - 1]) + char_length({matches}[i - 1]), 'v', {matches}[i - 1]))), a -> a.out)")


def with_spans(rows: DataFrame, name: str, pattern: str, hint: Column) -> DataFrame:
    """``rows`` with the array column ``name`` of a pattern's matches in ``__body``."""
    empty = "cast(array() as array<struct<start:int,end:int,v:string>>)"
    found = rows.withColumn("__m", F.when(hint, F.regexp_extract_all("__body", F.lit(pattern), 0)))
    parted = found.withColumn("__s", F.when(F.size("__m") > 0, F.split("__body", pattern, -1)))
    return parted.withColumn(name, F.when(F.size("__m") > 0, spans("__m", "__s")).otherwise(F.expr(empty))).drop("__m", "__s")


def mentions(rows: DataFrame) -> DataFrame:
    """``rows`` (with ``__body``) plus ``__base``: (kind, start, end, v, left, right), and ``__more``: the same of candidates."""
    digits = F.col("__body").rlike("[0-9]")
    body = rows.withColumn("__digits", digits)
    for kind in KINDS:
        hint = F.col("__digits") if kind not in HINT else F.contains("__body", F.lit(HINT[kind]))
        body = with_spans(body, f"__{kind}", PATTERNS[kind], hint)
        body = body.withColumn(f"__{kind}", F.expr(f"filter(transform(__{kind}, x -> named_struct('start', x.start, 'end', x.end, 'v', x.v)), x -> "
                                                   f"{VALID[kind].replace('(v,', '(x.v,')})"))
    body = with_spans(body, "__words", CANDIDATE, F.col("__digits"))
    # Beside a white space the neighbour is the word across it; otherwise the text that touches.
    around = ("'left', lower(translate(regexp_extract(substring(__body, greatest(x.start - {n} + 1, 1), least({n}, x.start)), '(\\\\S+)\\\\s*$', 1), '0123456789', '0000000000')), "
              "'right', lower(translate(regexp_extract(substring(__body, x.end + 1, {n}), '^\\\\s*(\\\\S+)', 1), '0123456789', '0000000000'))").format(n=CONTEXT)
    base = F.expr("concat(" + ", ".join(
        f"transform(__{kind}, x -> named_struct('kind', {i}, 'start', x.start, 'end', x.end, 'v', x.v, {around}))"
        for i, kind in enumerate(KINDS)) + ")")
    more = F.expr(
        f"transform(filter(__words, x -> length(regexp_replace(x.v, '[^0-9]', '')) >= {CANDIDATE_DIGITS}"
        f" and not exists(__base, b -> b.start < x.end and b.end > x.start)), "
        f"x -> named_struct('kind', cast(null as int), 'start', x.start, 'end', x.end, 'v', x.v, {around}))")
    return (body.withColumn("__base", base).withColumn("__more", more)
            .drop("__digits", "__words", *[f"__{k}" for k in KINDS]))


def discover(found: DataFrame) -> DataFrame:
    """``v, kind`` of the identifiers that the rounds add to the base entities."""
    every = (found.select(F.explode(F.concat("__base", "__more")).alias("m")).select("m.*"))
    patterns = F.filter(F.array(
        F.struct(F.lit("l").alias("side"), F.col("left").alias("words")),
        F.struct(F.lit("r").alias("side"), F.col("right").alias("words")),
        F.struct(F.lit("b").alias("side"), F.concat_ws(" _ ", "left", "right").alias("words"))), lambda p: F.length(p["words"]) > 0)
    # The graph: each pattern and identifier once, however many copies of a text repeat them.
    graph = saved(every.select("v", "kind", F.explode(patterns).alias("p")).select("v", "kind", "p.side", "p.words").distinct(), "pii-graph")
    edges = graph.groupBy("side", "words", "v").agg(F.min("kind").alias("kind"))
    known = None
    while True:  # each round but the last learns at least one identifier
        now = edges if known is None else edges.join(known.withColumnRenamed("kind", "learnt"), "v", "left").select(
            "side", "words", "v", F.coalesce("kind", "learnt").alias("kind"))
        counts = [F.count_if(F.col("kind") == i).alias(f"k{i}") for i in range(len(KINDS))]
        scores = now.groupBy("side", "words").agg(F.count(F.lit(1)).alias("n"), *counts)
        most = F.greatest(*[F.col(f"k{i}") for i in range(len(KINDS))])
        trusted = (scores.withColumn("most", most).where((F.col("most") >= SUPPORT) & (F.col("most") >= CONFIDENCE * F.col("n")))
                   .select("side", "words", F.coalesce(*[F.when(F.col(f"k{i}") == F.col("most"), i) for i in range(len(KINDS))]).alias("says"),
                           F.log2(F.col("most") + 1).alias("weight")))
        votes = (now.where("kind is null").join(trusted, ["side", "words"])
                 .groupBy("v", "says").agg(F.sum("weight").alias("score")))
        fresh = saved(votes.groupBy("v").agg(F.max_by("says", F.struct("score", -F.col("says"))).alias("kind")), "pii-learnt")
        if not fresh.take(1):
            break
        known = fresh if known is None else known.unionByName(fresh)
    if known is None:
        return found.sparkSession.createDataFrame([], "v string, kind int")
    return known


def _texts(array: str) -> Column:
    names = ", ".join(f"'{k}'" for k in KINDS)
    return F.expr(f"concat_ws(',', transform({array}, x -> concat(array({names})[x.kind], ':', x.start, ':', x.end)))")


ADDED = ["n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans"]


def find_personal_data(docs: DataFrame, text: str = "text", columns: list[str] | None = None, redact: bool = False) -> DataFrame:
    """``docs`` (or ``columns`` of it) with counts of the base kinds, ``base_sha256`` and ``spans``.

    ``redact`` replaces every span in the text by its kind in brackets, overlapping spans by the
    first.  Null and empty texts hold nothing; a very long text is read whole, by one task; repeated rows are read
    each; an identifier with equal votes for two kinds takes the first as listed; an empty table gives an
    empty table; columns named like the added ones are replaced.
    """
    private = ["__body", "__row", "__base", "__more", "__new", "__all", "__digits", "__words", *[f"__{k}" for k in KINDS]]
    docs = without(docs, [*ADDED, *private])
    kept = columns or docs.columns
    rows = docs.select(*[quoted(c) for c in kept], F.coalesce(quoted(text).cast("string"), F.lit("")).alias("__body"))
    done = mentions(rows).withColumn("__row", F.monotonically_increasing_id()).drop("__body")
    found = saved(done, "pii-mentions")
    learnt = discover(found.select("__base", "__more"))
    new = (found.where(F.size("__more") > 0).select("__row", F.inline("__more")).drop("kind")
           .join(learnt, "v").groupBy("__row")
           .agg(F.collect_list(F.struct("kind", "start", "end")).alias("__new")))
    short = F.expr("transform(__base, x -> named_struct('kind', x.kind, 'start', x.start, 'end', x.end))")
    # Only rows with candidates meet what was learnt; the others stay where they are.
    met = found.where(F.size("__more") > 0).join(new, "__row", "left")
    rest = found.where(F.size("__more") == 0).withColumn("__new", F.lit(None).cast(new.schema["__new"].dataType))
    whole = met.unionByName(rest).withColumn(
        "__all", F.array_sort(F.concat(short, F.coalesce("__new", F.array().cast(new.schema["__new"].dataType)))))
    counts = [F.expr(f"cast(size(filter(__base, x -> x.kind = {i})) as long)").alias(f"n_{k}") for i, k in enumerate(KINDS)]
    out = [quoted(c) for c in kept]
    if redact:
        names = ", ".join(f"'[{k.upper()}]'" for k in KINDS)
        body = F.expr(
            f"aggregate(array_sort(transform(__all, x -> named_struct('start', x.start, 'end', x.end, 'kind', x.kind))),"
            f" named_struct('at', 0, 'out', ''), (a, x) -> if(x.start < a.at, a, named_struct('at', x.end, 'out',"
            f" concat(a.out, substring(`{text}`, a.at + 1, x.start - a.at), array({names})[x.kind]))),"
            f" a -> concat(a.out, substring(`{text}`, a.at + 1)))")
        out = [F.when(F.size("__all") > 0, body).otherwise(quoted(c)).alias(c) if c == text else quoted(c) for c in kept]
    return whole.select(*out, *counts, F.sha2(_texts("__base"), 256).alias("base_sha256"), _texts("__all").alias("spans"))
