"""Personal data: base patterns, and identifiers that only their context gives away.

Base entities are the seeds.  The words before a seed are its lexical pattern; every other token with a digit or
an @ is a candidate instance that stands behind some pattern.  Where another instance stands between, the words
before that one are the pattern; where a text begins with an instance, the pattern is empty.  Patterns and instances form a bipartite graph:
a pattern is as good as the instances behind it, an instance as good as the patterns in front of it, and both
are scored in turn by joins and aggregates.  Candidates behind patterns of high confidence are reported as ``id``.

Everything is column expressions and SQL functions.  A text is split at its matches, so the place of each match
is the length of what was before it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..session import is_empty, materialize

# fixed values: base kinds in order.  Possessive repeats and the look-behinds give the leftmost non-overlapping
# matches of the plain patterns without trying every start inside a run, and without deep recursion
_MAIL, _DIGIT = "[A-Za-z0-9._%+-]", "[0-9]"
BASE = {
    "email": rf"(?:\G|(?<!{_MAIL})){_MAIL}++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": rf"(?:\G|(?<!{_DIGIT}))[0-9]++(?:\.[0-9]++){{3}}",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
KINDS = (*BASE, "id")
# a candidate: at most two words before it, and a token that holds a digit or an @
_WORD = r"[^\s0-9@]++"
CANDIDATE = rf"(?<!\S)((?:{_WORD}\s++){{0,2}})([^\s0-9@]*+[0-9@]\S*+)"
LEAD = rf"(?<!\S)(?:{_WORD}\s++)?{_WORD}\s*+\z"  # the words that end a text
_TAIL = r"(?<![^\p{L}\p{N}_+)])[^\p{L}\p{N}_+)]++\z"  # marks behind a token
ROUNDS = 3
TRUST, SUPPORT = 0.8, 5.0  # least confidence and least seed weight of a pattern that may discover


def _luhn(digits: Column) -> Column:
    places = F.sequence(F.lit(1), F.length(digits))

    def worth(i: Column) -> Column:
        d = F.substring(F.reverse(digits), i, F.lit(1)).cast("int")
        twice = d * 2 - F.when(d > 4, 9).otherwise(0)
        return F.when(i % 2 == 0, twice).otherwise(d)

    return F.aggregate(F.transform(places, worth), F.lit(0), lambda a, b: a + b) % 10 == 0


def _holds(kind: str, body: Column) -> Column:
    digits = F.regexp_replace(body, "[^0-9]", "")
    if kind == "email":
        return F.lit(True)
    if kind == "ip":
        # leading zeros do not count; more than three digits left are more than 255
        return F.forall(F.split(body, r"\."), lambda p: F.regexp_replace(p, "^0+(?=[0-9])", "").rlike(
            "^([0-9]|[1-9][0-9]|1[0-9][0-9]|2[0-4][0-9]|25[0-5])$"))
    if kind == "card":
        return F.when(F.length(digits).between(12, 19), _luhn(digits)).otherwise(False)
    return F.length(digits).between(9, 15)


def _matches(rows: DataFrame, pattern: str) -> DataFrame:
    """(row, start, end, body, gap) of every match, in code points; a 0 stands for what is before the gap."""
    parts = rows.select("row", F.split("text", pattern, -1).alias("gaps"), F.regexp_extract_all("text", F.lit(pattern), F.lit(0)).alias("hits"))
    # the place of a match is the sum of what stands before it: summed over the rows of a text, not inside an array
    cells = parts.filter(F.size("hits") > 0).select("row", F.posexplode(F.arrays_zip("gaps", "hits")).alias("at", "cell"))
    cells = cells.select("row", "at", "cell.hits", F.length("cell.gaps").alias("gap"), F.coalesce(F.length("cell.hits"), F.lit(0)).alias("size"),
                         F.when(F.col("at") > 0, F.concat(F.lit("0"), "cell.gaps")).otherwise(F.col("cell.gaps")).alias("before"))
    upto = Window.partitionBy("row").orderBy("at").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = cells.withColumn("end", F.sum(F.col("gap") + F.col("size")).over(upto)).filter("hits is not null")
    return placed.select("row", (F.col("end") - F.col("size")).alias("start"), "end", F.col("hits").alias("body"), F.col("before").alias("gap"))


def _words(lead: Column) -> Column:
    """Words in lower case with one blank between them; null if there are none."""
    return F.nullif(F.lower(F.trim(F.regexp_replace(lead, r"\s++", " "))), F.lit(""))


def base_spans(rows: DataFrame) -> DataFrame:
    """(row, kind, start, end, body, lead) of the base kinds for (row, text); the lead is the words right before."""
    out = None
    for kind, pattern in BASE.items():
        rough = {"email": F.instr("text", "@") > 0, "phone": F.instr("text", "+") > 0}.get(kind, F.lit(True))
        found = _matches(rows.filter(rough), pattern).filter(_holds(kind, F.col("body"))).select(
            "row", F.lit(kind).alias("kind"), "start", "end", "body", _words(F.regexp_extract("gap", LEAD, 0)).alias("lead"))
        out = found if out is None else out.unionByName(found)
    return out


def candidates(rows: DataFrame, base: DataFrame) -> DataFrame:
    """(row, start, end, instance, pattern, base): the base spans, tokens with a digit or an @, and the words before them."""
    found = _matches(rows, CANDIDATE)
    lead, token = F.regexp_extract("body", CANDIDATE, 1), F.regexp_extract("body", CANDIDATE, 2)
    token = F.regexp_replace(token, _TAIL, "")
    start = F.col("start") + F.length(lead)
    tokens = found.select("row", start.alias("start"), (start + F.length(token)).alias("end"), F.lower(token).alias("instance"),
                          _words(lead).alias("lead"), F.lit(False).alias("base"))
    every = tokens.unionByName(base.select("row", "start", "end", F.lower("body").alias("instance"), "lead", F.lit(True).alias("base")))
    upto = Window.partitionBy("row").orderBy("start", "base", "end").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    pattern = F.coalesce(F.last("lead", ignorenulls=True).over(upto), F.lit(""))
    return every.withColumn("pattern", pattern).filter("instance <> ''").drop("lead")


def discover(cand: DataFrame, seeds: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """Candidates (row, start, end) behind patterns of high confidence, seeds left out.

    A candidate that a base span covers starts with weight 1, every other with 0.  Per round a pattern's
    confidence is the mean weight of its distinct instances, and an instance's weight the best confidence of
    its patterns; seeds stay at 1.  Where ``cand`` has a column ``base`` that tells base spans, these stand for
    the tokens they cover.
    """
    # candidates and seeds of a text in one order: a seed that begins no later must end after the candidate's start, one
    # that begins later must begin before its end.  Two running extremes tell, without meeting every seed of the text
    spans = cand.withColumn("seed", F.lit(False)).unionByName(
        seeds.select("row", "start", "end", F.lit(True).alias("seed")), allowMissingColumns=True)
    upto = lambda order: Window.partitionBy("row").orderBy(order).rangeBetween(Window.unboundedPreceding, Window.currentRow)
    met = spans.withColumn("left", F.max(F.when(F.col("seed"), F.col("end"))).over(upto(F.col("start")))).withColumn(
        "right", F.min(F.when(F.col("seed"), F.col("start"))).over(upto(F.col("start").desc())))
    base = F.col("base") if "base" in cand.columns else F.lit(True)
    near = met.filter(~F.col("seed")).withColumn("base", base).select("base", "row", "start", "end", "instance", "pattern", F.coalesce(
        (F.col("left") > F.col("start")) | (F.col("right") < F.col("end")), F.lit(False)).alias("is_seed"))
    placed = materialize(near.filter(F.col("base") | ~F.col("is_seed")).drop("base"), "pii-candidates")
    # the graph: an edge per distinct (pattern, instance), copies of a text count once
    edges = materialize(placed.groupBy("pattern", "instance").agg(F.max("is_seed").alias("is_seed")), "pii-graph")
    weight = edges.groupBy("instance").agg(F.max(F.col("is_seed").cast("double")).alias("weight"))
    scores = None
    for k in range(rounds):
        scored = edges.join(weight, "instance")
        scores = materialize(scored.groupBy("pattern").agg(
            F.avg("weight").alias("confidence"), F.sum("weight").alias("support")), f"pii-patterns-{k}")
        weight = edges.join(scores.filter(F.col("support") >= SUPPORT), "pattern", "left").groupBy("instance").agg(
            F.greatest(F.max(F.col("is_seed").cast("double")), F.max(F.coalesce("confidence", F.lit(0.0)))).alias("weight"))
    good = scores.filter((F.col("confidence") >= TRUST) & (F.col("support") >= SUPPORT)).select("pattern")
    return placed.filter(~F.col("is_seed")).join(good, "pattern").select("row", "start", "end")


def find_personal_data(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: (id, n_email, n_ip, n_card, n_phone, base_sha256, spans), spans in code points.

    ``spans`` lists kind:start:end of base and discovered (``id``) spans by start, then kind; the digest is over
    the base spans alone.  A null text is an empty text.  Rows that repeat an id give one row, read as the
    greatest of their texts; rows without an id give no row.  Other columns are ignored.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("row"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text")).filter("row is not null")
    twice = rows.groupBy("row").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("row")
    if not is_empty(twice):
        twice = materialize(twice, "pii-repeated-ids")
        rows = rows.join(twice, "row", "left_anti").unionByName(rows.join(twice, "row").groupBy("row").agg(F.max("text").alias("text")))
    base = materialize(base_spans(rows), "pii-base")
    more = discover(candidates(rows.filter(F.col("text").rlike("[0-9@]")), base), base)
    order = F.lit(0)
    for i, kind in enumerate(KINDS):
        order = F.when(F.col("kind") == kind, i).otherwise(order)
    every = base.select("row", "kind", "start", "end").unionByName(more.select("row", F.lit("id").alias("kind"), "start", "end"))
    lists = every.groupBy("row").agg(F.sort_array(F.collect_list(F.struct("start", order.alias("rank"), "kind", "end"))).alias("spans"))
    wide = rows.select("row").join(lists, "row", "left").withColumn("spans", F.coalesce("spans", F.expr("cast(array() as array<struct<start:bigint,rank:int,kind:string,end:bigint>>)")))

    def joined(column: Column) -> Column:
        return F.array_join(F.transform(column, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")

    def count(kind: str) -> Column:
        return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    return wide.select(
        F.col("row").alias(id_col),
        *map(count, BASE),
        F.sha2(joined(F.filter("spans", lambda s: s["kind"] != "id")), 256).alias("base_sha256"),
        joined(F.col("spans")).alias("spans"))
