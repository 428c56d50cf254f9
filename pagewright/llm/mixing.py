"""Mixing sources to target weights over a tree of domain, language and source.

A node's tokens are divided among its children by weight; a child that holds less
than its share (over all its epochs) gives the shortage to its siblings, and only
what a whole subtree cannot supply goes up to the subtree's own siblings. Each
leaf then takes a prefix, in tokens, of its documents in the order of a seeded
hash, one order per epoch.

The prefix is found without sorting a leaf as a whole: tokens are summed by range
of the hash, the range in which the budget ends is found from these sums, and only
that range's documents are put in order. A hot source is thus no single task.

Defined results: tokens are runs of other than space, tab, CR and LF; a null or
empty text has none and is taken as soon as the documents before it leave any
budget over; null lang, source or domain is a value of its own, with the default
weight; ties of the hash go by doc_id, text and position of equal rows; repeated
rows are documents of their own. Nodes of weight 0 get nothing. Empty input gives
empty output. Shares are whole tokens, rounded down.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pagewright.llm.common import cut, prepare

SHARE = 0.5
EPOCHS = 2
SEED = "mix-1"
RANGES = 4096
MAX_BROADCAST_BYTES = 8 << 20
NONE = "\x00none"
#: Whole numbers; a name that is missing here has the weight DEFAULT_WEIGHT.
WEIGHTS: Mapping[str, Mapping[str, int]] = {"domain": {"d0": 40, "d1": 30, "d2": 20, "d3": 10}, "lang": {"en": 50, "de": 20, "fr": 20, "es": 10}, "source": {}}
DEFAULT_WEIGHT = 10


def default_domain(source: str = "source") -> Column:
    """The domain of a source: its number modulo 4 stands in for a catalogue of sources."""
    number = F.regexp_extract(F.coalesce(F.col(source), F.lit("")), "[0-9]+", 0)
    return F.when(number == "", F.lit(None)).otherwise(F.concat(F.lit("d"), (F.substring(number, -4, 4).cast("int") % 4).cast("string")))


def share_out(budget: int, children: list[tuple[str, int, int]]) -> dict[str, int]:
    """Tokens of each child (name, weight, capacity): by weight, with what full ones leave going to the others."""
    out = {name: 0 for name, _, _ in children}
    # Children fill up in the order of capacity by weight, so one pass finds who is full.
    rest = sorted((c for c in children if c[1] > 0), key=lambda c: (c[2] / c[1], c[0]))
    weight = sum(c[1] for c in rest)
    for k, (name, own, capacity) in enumerate(rest):
        if capacity * weight <= budget * own:
            out[name] = capacity
            budget -= capacity
            weight -= own
        else:
            for other, w, _ in rest[k:]:
                out[other] = budget * w // weight
            break
    return out


def budgets(tokens: Mapping[tuple[str, str, str], int], total: int, weights: Mapping[str, Mapping[str, int]] = WEIGHTS, epochs: int = EPOCHS) -> dict[tuple[str, str, str], int]:
    """Budget of each leaf (domain, lang, source) of which ``tokens`` has the size."""
    of = lambda level, name: weights.get(level, {}).get(name, DEFAULT_WEIGHT)
    tree: dict = defaultdict(lambda: defaultdict(dict))
    for (a, b, c), n in tokens.items():
        # A subtree can supply what its children of some weight can.
        tree[a][b][c] = n * epochs if of("source", c) > 0 else 0
    lang_room = {(a, b): sum(x.values()) if of("lang", b) > 0 else 0 for a, y in tree.items() for b, x in y.items()}
    room = {a: sum(lang_room[a, b] for b in y) for a, y in tree.items()}
    out = {}
    for a, x in share_out(total, [(a, of("domain", a), room[a]) for a in tree]).items():
        for b, y in share_out(x, [(b, of("lang", b), lang_room[a, b]) for b in tree[a]]).items():
            for c, z in share_out(y, [(c, of("source", c), tree[a][b][c]) for c in tree[a][b]]).items():
                out[a, b, c] = z
    return out


def token_count(text: str = "text") -> Column:
    return F.coalesce(F.regexp_count(F.col(text), F.lit(r"[^ \t\r\n]+")), F.lit(0)).cast("long")


def _place(seed: str, epoch: Column, doc_id: Column) -> Column:
    return F.md5(F.concat_ws("|", F.lit(seed), epoch.cast("string"), F.coalesce(doc_id.cast("string"), F.lit(NONE))))


def _range(place: Column) -> Column:
    return F.conv(F.substring(place, 1, 3), 16, 10).cast("int")


def mix(docs: DataFrame, share: float = SHARE, epochs: int = EPOCHS, seed: str = SEED, weights: Mapping[str, Mapping[str, int]] = WEIGHTS, domain: Column | None = None) -> DataFrame:
    """(row, domain, tokens, epoch): the chosen rows, each whole in a struct, once for each epoch (from 0) that takes it.

    ``share`` of all tokens are handed out. The tree's leaves are few (domains x
    languages x sources); their table is broadcast up to MAX_BROADCAST_BYTES and
    joined by shuffling beyond.
    """
    spark = docs.sparkSession
    prepare(spark)
    blank = lambda c: F.coalesce(c, F.lit(NONE))
    known = docs.select(F.struct(F.col("*")).alias("row"), F.col("doc_id").alias("id"), blank(default_domain() if domain is None else domain).alias("domain"), blank(F.col("lang")).alias("lang"), blank(F.col("source")).alias("source"), token_count().alias("tokens"))
    leaf = ["domain", "lang", "source"]
    # Sums for every epoch's order at once: each row falls in one range of each.
    orders = [F.struct(F.lit(e).alias("e"), _range(_place(seed, F.lit(e), F.col("id"))).alias("r")) for e in range(epochs)]
    sums = cut(known.select(*leaf, "tokens", F.explode(F.array(*orders)).alias("at")).groupBy(*leaf, F.col("at.e").alias("e"), F.col("at.r").alias("r")).agg(F.sum("tokens").alias("n")))
    by_leaf = sums.where("e = 0").groupBy(*leaf).agg(F.sum("n").alias("n")).collect()
    size = {tuple(r[c] for c in leaf): r["n"] for r in by_leaf}
    goal = budgets(size, int(sum(size.values()) * share), weights, epochs)
    plan = []
    for key, n in size.items():
        full = min(goal[key] // n, epochs) if n else 0
        plan.append((*key, int(full), int(goal[key] - full * n)))
    schema = T.StructType([*[T.StructField(c, T.StringType()) for c in leaf], T.StructField("full", T.IntegerType()), T.StructField("rest", T.LongType())])
    goals = spark.createDataFrame(plan, schema)
    near = F.broadcast if sum(64 + sum(len(x.encode()) for x in p[:3]) for p in plan) <= MAX_BROADCAST_BYTES else (lambda x: x)
    # The range in which each leaf's last epoch ends: tokens before it, and its number.
    before = Window.partitionBy(*leaf).orderBy("r").rowsBetween(Window.unboundedPreceding, -1)
    ends = sums.join(goals, leaf).where("e = full").withColumn("b", F.coalesce(F.sum("n").over(before), F.lit(0))).where("b < rest")
    ends = ends.groupBy(*leaf).agg(F.max_by(F.struct("r", "b"), "r").alias("end"))
    limits = goals.join(ends, leaf, "left").select(*leaf, "full", "rest", F.coalesce("end.r", F.lit(-1)).alias("last"), F.coalesce("end.b", F.lit(0)).cast("long").alias("before"))
    placed = known.join(near(limits), leaf).withColumn("place", _place(seed, F.col("full"), F.col("id"))).withColumn("range", _range(F.col("place")))
    inner = placed.where("range = last").select("id", *leaf, "place", "tokens", "before", "rest", F.xxhash64("row.text").alias("mark"))
    run = Window.partitionBy(*leaf).orderBy("place", F.col("id"), "mark").rowsBetween(Window.unboundedPreceding, -1)
    taken = inner.withColumn("sum", F.col("before") + F.coalesce(F.sum("tokens").over(run), F.lit(0))).where("sum < rest")
    taken = taken.groupBy(*[F.col(c).alias(f"{c}2") for c in leaf], F.col("id").alias("id2"), F.col("mark").alias("mark2")).agg(F.count("*").alias("copies"))
    clear = placed.where("range <> last").withColumn("n", F.col("full") + (F.col("range") < F.col("last")).cast("int"))
    same = Window.partitionBy(*leaf, "id", "mark").orderBy(F.lit(1))
    edge = placed.where("range = last").withColumn("mark", F.xxhash64("row.text")).withColumn("k", F.row_number().over(same))
    edge = edge.join(taken, [*[F.col(c) == F.col(f"{c}2") for c in leaf], F.col("id").eqNullSafe(F.col("id2")), F.col("mark") == F.col("mark2")], "left")
    edge = edge.withColumn("n", F.col("full") + (F.col("k") <= F.coalesce("copies", F.lit(0))).cast("int"))
    names = ["row", "domain", "tokens", "n"]
    chosen = clear.select(*names).unionByName(edge.select(*names)).where("n > 0")
    return chosen.select("row", F.nullif(F.col("domain"), F.lit(NONE)).alias("domain"), "tokens", F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("epoch"))


def mixed(docs: DataFrame, **options) -> DataFrame:
    """(doc_id, domain, lang, source, tokens, epoch) of each row chosen."""
    found = mix(docs.select("doc_id", "text", "lang", "source"), **options)
    return found.select("row.doc_id", "domain", "row.lang", "row.source", "tokens", "epoch")


def take_mix(docs: DataFrame, **options) -> DataFrame:
    """The chosen rows with the columns of ``docs``; once for each epoch that takes them."""
    return mix(docs, **options).select("row.*")


def _level(name: str, parents: list[str], weights: Mapping[str, int], room: str, out: str) -> str:
    """SQL of one level: each child's whole tokens from its parent's column ``given``."""
    weight = "CASE " + " ".join(f"WHEN {name} = '{k}' THEN {v}" for k, v in weights.items()) + f" ELSE {DEFAULT_WEIGHT} END" if weights else str(DEFAULT_WEIGHT)
    by = "PARTITION BY " + ", ".join(parents) if parents else ""
    keys = ", ".join([*parents, name])
    first = f"(SELECT {keys}, given, SUM({room})::HUGEINT AS room, ({weight})::HUGEINT AS w FROM {{src}} GROUP BY {keys}, given)"
    return f"""{out} AS (
  SELECT *, CASE WHEN full_here THEN room ELSE left_over * w // left_weight END AS got FROM (
    SELECT *, given - COALESCE(SUM(CASE WHEN full_here THEN room END) OVER ({by}), 0) AS left_over,
           SUM(CASE WHEN NOT full_here THEN w END) OVER ({by}) AS left_weight FROM (
      SELECT *, BOOL_AND(fits) OVER ({by} ORDER BY room / w, {name} ROWS UNBOUNDED PRECEDING) AS full_here FROM (
        SELECT *, room * SUM(w) OVER ({by} ORDER BY room / w, {name} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)
          <= (given - COALESCE(SUM(room) OVER ({by} ORDER BY room / w, {name} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) * w AS fits FROM {first}))))"""


def oracle(share: float = SHARE, epochs: int = EPOCHS, seed: str = SEED) -> str:
    """DuckDB SQL for mixed() with the default weights, where no lang or source is null."""
    d = _level("domain", [], WEIGHTS["domain"], "room", "by_domain").replace("{src}", "leaves")
    g = _level("lang", ["domain"], WEIGHTS["lang"], "room", "by_lang").replace("{src}", "(SELECT l.domain, l.lang, l.source, l.room, d.got AS given FROM leaves l JOIN by_domain d USING (domain))")
    s = _level("source", ["domain", "lang"], WEIGHTS["source"], "room", "by_source").replace("{src}", "(SELECT l.domain, l.lang, l.source, l.room, g.got AS given FROM leaves l JOIN by_lang g USING (domain, lang))")
    return f"""WITH known AS (
  SELECT doc_id, lang, source, 'd' || (CAST(right(regexp_extract(source, '[0-9]+'), 4) AS INTEGER) % 4) AS domain,
         len(regexp_extract_all(text, '[^ \\t\\r\\n]+')) AS tokens FROM documents),
leaves AS (SELECT domain, lang, source, SUM(tokens)::HUGEINT * {epochs} AS room, SUM(tokens)::HUGEINT AS n,
  CAST(floor((SELECT SUM(tokens) FROM known) * {share}::DOUBLE) AS HUGEINT) AS given FROM known GROUP BY ALL),
{d},
{g},
{s},
goals AS (SELECT l.domain, l.lang, l.source, LEAST(s.got // l.n, {epochs}) AS f, s.got - LEAST(s.got // l.n, {epochs}) * l.n AS rest
  FROM leaves l JOIN by_source s USING (domain, lang, source)),
ordered AS (SELECT k.*, f, rest, COALESCE(SUM(tokens) OVER (PARTITION BY domain, lang, source
    ORDER BY md5('{seed}|' || f || '|' || doc_id), doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
  FROM known k JOIN goals USING (domain, lang, source)),
copies AS (SELECT *, f + CASE WHEN before < rest THEN 1 ELSE 0 END AS c FROM ordered)
SELECT doc_id, domain, lang, source, tokens, CAST(e AS INTEGER) AS epoch FROM copies, range({epochs} + 1) t(e) WHERE e < c"""
