"""Operator 11: a point-in-time feature table by square-root decomposition.

Every sale asks, at a time t of its own, what was known of its client then.  A
row of history (a click, a sale, a line) counts for a window of d days from the
time it is known until d days after it happened: an interval of t.  A client's
probes, in order of t, are cut into equal-count blocks of about the square root
of their number.  An interval then

* covers whole blocks: it is added once where it begins to cover and taken off
  once where it ends, per block, and sums over a client's blocks carry it on;
* overlaps at most two blocks partially: there it meets only that block's probes,
  in sums over the block.

So no row is copied to the probes or blocks it counts for, and a block's work is
about the square root of its client's probes.  The different items of a window
are the union of the item's intervals: an interval counts only beyond the
furthest end of those that begin before it, found within the block it begins in
and, from one row a block, over the blocks before.

Places of times among a client's probes come from counts: within a slice of
`SLICE` microseconds of one client, and of the slices before.  A hot client is
spread over its slices and blocks; a hot sale's lines meet by (client, item,
place) before they are shuffled.

Times without a zone are taken as UTC; days have 24 hours.

Defined cases: a sale without client, sold_at or sale_id has no row; a sale's
own arrival may be null (it then counts for no window, but for labels); clicks
without client, ts or arrival, and lines without shipped_at or a known sale
count nowhere; null amounts count 0; a null click_id ranks below all others;
equal clicks count once, equal lines each; a sale_id of several rows has a row
each, with the lines of all rows of that id joined to each; empty tables give no
rows, or zeros; extra columns are ignored but tell clicks apart.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import forget, materialize, table
from .sql import CRC32_STEPS, crc32

DAY = 86_400_000_000
#: Days looked back, days looked ahead, minutes until an arrived row can be used, seconds over which the probes' times are spread.
WINDOWS, HORIZON, DELAY, SPREAD = (2, 14), 7, 240, 259_200
#: Microseconds of a slice of a client's time in which places are counted.
SLICE = 4 * 3_600_000_000

_LO, _END, _AHEAD, _SOLD = "lo", "end", "ahead", "sold"
#: What is counted for each window.
SUMS = ("n_clicks", "n_purchases", "click_cents", "n_sales", "sale_cents", "n_lines", "line_cents", "n_items")


def micros(df: DataFrame, name: str) -> Column:
    """Microseconds since 1970 of a time, UTC where it has no zone, whatever the session's zone."""
    c = F.col(name)
    if dict(df.dtypes)[name] == "timestamp":
        return F.unix_micros(c)
    clock = (F.hour(c) * 3600 + F.minute(c) * 60).cast("long") * 1_000_000 + (F.expr(f"extract(SECOND FROM `{name}`)") * 1_000_000).cast("long")
    return F.unix_date(c.cast("date")).cast("long") * DAY + clock


def cents(name: str) -> Column:
    return F.coalesce(F.floor(F.col(name) * 100 + 0.5), F.lit(0)).cast("long")


def _points(rows: DataFrame, kind: str, windows: tuple[int, ...], more: list[Column]) -> DataFrame:
    """Where the intervals of rows (client, at, known, id, cents, purchase) begin and end: a row a time, with a weight for each window."""
    def holds(d: int) -> Column:
        return F.col("known") < F.col("at") + d * DAY

    def point(x: Column, role: str, weight: dict[int, Column], label: int = 0) -> Column:
        return F.struct(x.alias("x"), F.lit(role).alias("role"), F.lit(label).alias("label"), *[weight.get(d, F.lit(0)).cast("int").alias(f"w{d}") for d in windows])

    out = [point(F.col("known"), _LO, {d: holds(d) for d in windows})]
    out += [point(F.col("at") + d * DAY, f"{_END}{d}", {d: -holds(d).cast("int")}) for d in windows]
    every = F.array(*out, *more)
    spread = rows.withColumn("p", F.explode(F.filter(every, lambda p: (p["label"] != 0) | _any(p, windows))))
    return spread.select("client", "p.*", F.lit(kind).alias("kind"), "id", "at", "cents", "purchase")


def _any(p: Column, windows: tuple[int, ...]) -> Column:
    out = F.lit(False)
    for d in windows:
        out = out | (p[f"w{d}"] != 0)
    return out


def _placed(points: DataFrame) -> DataFrame:
    """points with `rank`, the number of the client's probes before their time x, `n`, the number of its probes, and `block`; those after all probes go."""
    points = points.withColumn("slice", F.floor(F.col("x") / SLICE))
    probe = (F.col("kind") == "probe").cast("long")
    sizes = points.groupBy("client", "slice").agg(F.sum(probe).alias("_n"))
    of = Window.partitionBy("client")
    before = F.sum("_n").over(of.orderBy("slice").rowsBetween(Window.unboundedPreceding, -1))
    sizes = sizes.select("client", "slice", F.coalesce(before, F.lit(0)).alias("_before"), F.sum("_n").over(of).alias("n")).where("n > 0")
    # at equal times a point stands before the probe: that probe already counts it
    inside = Window.partitionBy("client", "slice").orderBy("x", probe).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    out = points.withColumn("_in", F.sum(probe).over(inside)).join(sizes, ["client", "slice"])
    out = out.withColumn("rank", F.col("_before") + F.col("_in") - probe).where("rank < n")
    return out.drop("slice", "_before", "_in").withColumn("block", _block(F.col("rank")))


def _block(rank: Column) -> Column:
    """A client's block of a place: blocks of about the square root of its n probes."""
    return F.floor(rank / F.ceil(F.sqrt("n"))).cast("long")


def _item_points(lines: DataFrame, windows: tuple[int, ...]) -> DataFrame:
    """The intervals of each (client, item) made disjoint: lines (client, item, n, rank, ends) to the places where an item begins or ends to be in a window."""
    ends = [f"e{d}" for d in windows]
    once = lines.where("item IS NOT NULL").groupBy("client", "n", "item", _block(F.col("rank")).alias("block"), "rank").agg(*[F.max(e).alias(e) for e in ends])
    once = materialize(once, "pit-items")
    ahead = Window.unboundedPreceding, -1
    blocks = once.groupBy("client", "item", "block").agg(*[F.max(e).alias(e) for e in ends])
    over = Window.partitionBy("client", "item").orderBy("block").rowsBetween(*ahead)
    blocks = blocks.select("client", "item", "block", *[F.max(e).over(over).alias(f"b{e}") for e in ends])
    inside = Window.partitionBy("client", "item", "block").orderBy("rank").rowsBetween(*ahead)
    met = once.select("*", *[F.max(e).over(inside).alias(f"i{e}") for e in ends]).join(blocks, ["client", "item", "block"])
    starts = {d: F.greatest("rank", F.coalesce(F.col(f"ie{d}"), F.lit(0)), F.coalesce(F.col(f"be{d}"), F.lit(0))) for d in windows}

    def point(rank: Column, sign: int, d: int) -> Column:
        return F.struct(rank.alias("rank"), *[F.lit(sign if x == d else 0).alias(f"w{x}") for x in windows], (F.col(f"e{d}") > starts[d]).alias("new"))

    parts = [point(at, sign, d) for d in windows for at, sign in ((starts[d], 1), (F.col(f"e{d}"), -1))]
    return met.withColumn("p", F.explode(F.array(*parts))).where("p.new").select("client", "n", "p.rank", *[f"p.w{d}" for d in windows])


def features(sales: DataFrame, clicks: DataFrame, lines: DataFrame, windows: tuple[int, ...] = WINDOWS, horizon: int = HORIZON, delay: int = DELAY, spread: int = SPREAD) -> DataFrame:
    """sale_id, d, t_us, label and, for each window of d days before t, the counts and sums of what was known at t."""
    sold, arrived = micros(sales, "sold_at"), micros(sales, "arrived_at")
    sold_rows = sales.where("client_id IS NOT NULL AND sold_at IS NOT NULL").select(F.col("client_id").alias("client"), "sale_id", sold.alias("at"), F.greatest(sold, arrived + F.lit(delay * 60_000_000)).alias("known"), F.col("arrived_at").isNotNull().alias("came"), cents("total").alias("cents"))
    sold_rows = sold_rows.withColumn("known", F.when(F.col("came"), F.col("known")))
    # rows of one sale_id are told apart by what they say
    sold_rows = sold_rows.withColumn("id", F.xxhash64("sale_id", "client", "at", "known", "cents"))
    t = F.col("at") + F.pmod(F.crc32(F.col("sale_id").cast("string").cast("binary")), F.lit(spread)) * 1_000_000
    zeros = [F.lit(0).alias(f"w{d}") for d in windows]
    probes = sold_rows.where("sale_id IS NOT NULL").select("client", t.alias("x"), F.lit("probe").alias("role"), F.lit(0).alias("label"), *zeros, F.lit("probe").alias("kind"), F.col("sale_id").alias("id"), "at", "cents", F.lit(0).alias("purchase"))

    def label(x: Column, role: str, sign: int) -> Column:
        return F.struct(x.alias("x"), F.lit(role).alias("role"), F.lit(sign).alias("label"), *[z.cast("int").alias(f"w{d}") for d, z in zip(windows, zeros, strict=True)])

    ahead = [label(F.col("at") - horizon * DAY, _AHEAD, 1), label(F.col("at"), _SOLD, -1)]
    sale_points = _points(sold_rows.withColumn("purchase", F.lit(0)), "sale", windows, ahead)

    seen = clicks.where("client_id IS NOT NULL AND ts IS NOT NULL AND arrived_at IS NOT NULL").dropDuplicates()
    ts = micros(clicks, "ts")
    seen = seen.select(F.col("client_id").alias("client"), ts.alias("at"), F.greatest(ts, micros(clicks, "arrived_at") + F.lit(delay * 60_000_000)).alias("known"), F.col("click_id").alias("id"), cents("value").alias("cents"), (F.coalesce(F.col("kind"), F.lit("")) == "purchase").cast("int").alias("purchase"))
    click_points = _points(seen, "click", windows, [])

    usable = sold_rows.where(f"known < at + {max(windows) * DAY}").select("sale_id", "client", F.col("id").alias("sale"))
    shipped = lines.where("sale_id IS NOT NULL AND shipped_at IS NOT NULL").select("sale_id", F.col("item_id").alias("item"), cents("amount").alias("cents"), micros(lines, "shipped_at").alias("x"))
    bought = materialize(shipped.join(usable, "sale_id").groupBy("client", "sale", "item", "x").agg(F.count("*").alias("m"), F.sum("cents").alias("cents")), "pit-lines")
    ships = bought.select("client", "x").distinct().select("client", "x", F.lit("ship").alias("role"), F.lit(0).alias("label"), *zeros, F.lit("ship").alias("kind"), F.lit(0).cast("long").alias("id"), F.lit(0).cast("long").alias("at"), F.lit(0).cast("long").alias("cents"), F.lit(0).alias("purchase"))

    points = materialize(probes.unionByName(sale_points).unionByName(click_points).unionByName(ships), "pit-points")
    placed = materialize(_placed(points), "pit-placed")

    # a line counts from the later of its sale's place and its shipping's; places beyond the last probe were left out
    past = F.lit((1 << 62))
    roles = {"rank": _LO} | {f"e{d}": f"{_END}{d}" for d in windows}
    of_sale = placed.where((F.col("kind") == "sale") & F.col("role").isin(list(roles.values()))).groupBy(F.col("id").alias("sale"), "client", "n").agg(*[F.max(F.when(F.col("role") == r, F.col("rank"))).alias(c) for c, r in roles.items()], *[F.max(f"w{d}").alias(f"v{d}") for d in windows])
    of_sale = of_sale.where("rank IS NOT NULL").select("sale", "client", "n", F.col("rank").alias("sale_rank"), *[F.when(F.col(f"v{d}") > 0, F.coalesce(F.col(f"e{d}"), past)).otherwise(0).alias(f"e{d}") for d in windows])
    of_ship = placed.where("kind = 'ship'").select("client", "x", F.col("rank").alias("ship_rank"))
    counted = bought.join(of_ship, ["client", "x"]).join(of_sale, ["client", "sale"]).withColumn("rank", F.greatest("sale_rank", "ship_rank"))
    counted = counted.where(_reaches(windows)).groupBy("client", "n", "item", "rank", *[f"e{d}" for d in windows]).agg(F.sum("m").alias("m"), F.sum("cents").alias("cents"))
    counted = materialize(counted, "pit-counted")
    line_parts = [F.struct(at.alias("rank"), *[(F.lit(sign if x == d else 0) * (F.col(f"e{d}") > F.col("rank")).cast("int")).alias(f"w{x}") for x in windows]) for d in windows for at, sign in ((F.col("rank"), 1), (F.col(f"e{d}"), -1))]
    line_points = counted.withColumn("p", F.explode(F.array(*line_parts))).select("client", "n", "p.*", "m", "cents")
    item_points = _item_points(counted, windows)

    zero = F.lit(0).cast("long")

    def sums(of: dict[str, Column]) -> list[Column]:
        """The summed columns of a source, by window: a weight times what it counts."""
        return [(F.col(f"w{d}").cast("long") * of[s] if s in of else zero).alias(f"{s}_{d}") for d in windows for s in SUMS]

    kind, one = F.col("kind"), F.lit(1).cast("long")
    click, sale = (kind == "click").cast("long"), (kind == "sale").cast("long")
    last = F.when((kind == "click") & (F.col("role") == _LO), F.struct(F.col("at").alias("ts"), F.col("id").alias("click_id")))
    is_probe = kind == "probe"
    main = placed.where("kind <> 'ship'").select("client", "n", "rank", F.col("label").cast("long").alias("label"), last.alias("last"), F.when(is_probe, F.col("id")).alias("sale_id"), F.when(is_probe, F.col("x")).alias("t"), *sums({"n_clicks": click, "n_purchases": click * F.col("purchase"), "click_cents": click * F.col("cents"), "n_sales": sale, "sale_cents": sale * F.col("cents")}))
    none = [zero.alias("label"), F.lit(None).cast("struct<ts:bigint,click_id:bigint>").alias("last"), F.lit(None).cast("long").alias("sale_id"), F.lit(None).cast("long").alias("t")]
    both = main.unionByName(line_points.where("rank < n").select("client", "n", "rank", *none, *sums({"n_lines": F.col("m"), "line_cents": F.col("cents")})))
    both = both.unionByName(item_points.where("rank < n").select("client", "n", "rank", *none, *sums({"n_items": one})))

    names = ["label", *[f"{s}_{d}" for d in windows for s in SUMS]]
    cells = both.groupBy("client", _block(F.col("rank")).alias("block"), "rank").agg(F.max("sale_id").alias("sale_id"), F.max("t").alias("t"), F.max("last").alias("last"), *[F.sum(c).alias(c) for c in names])
    cells = materialize(cells, "pit-cells")
    forget(points)
    earlier = Window.partitionBy("client").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = cells.groupBy("client", "block").agg(F.max("last").alias("last"), *[F.sum(c).alias(c) for c in names])
    blocks = blocks.select("client", "block", F.max("last").over(earlier).alias("_last"), *[F.coalesce(F.sum(c).over(earlier), zero).alias(f"_{c}") for c in names])
    upto = Window.partitionBy("client", "block").orderBy("rank").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    run = cells.select("client", "block", "sale_id", "t", F.max("last").over(upto).alias("last"), *[F.sum(c).over(upto).alias(c) for c in names])
    run = run.where("t IS NOT NULL").join(blocks, ["client", "block"])
    run = run.select("sale_id", "t", F.greatest("last", "_last").alias("last"), *[(F.col(c) + F.col(f"_{c}")).alias(c) for c in names])

    def row(d: int) -> Column:
        return F.struct(F.lit(d).cast("int").alias("d"), F.when(F.col("last.ts") > F.col("t") - d * DAY, F.col("last.click_id")).alias("last_click_id"), *[F.col(f"{s}_{d}").alias(s) for s in SUMS])

    out = run.select("sale_id", F.col("t").alias("t_us"), (F.col("label") > 0).alias("label"), F.explode(F.array(*[row(d) for d in windows])).alias("r"))
    return out.select("sale_id", "r.d", "t_us", "label", "r.n_clicks", "r.n_purchases", "r.click_cents", "r.last_click_id", "r.n_sales", "r.sale_cents", "r.n_lines", "r.n_items", "r.line_cents")


def _reaches(windows: tuple[int, ...]) -> Column:
    out = F.lit(False)
    for d in windows:
        out = out | (F.col("rank") < F.col(f"e{d}"))
    return out


def op11_point_in_time(spark: SparkSession, sf_dir: str) -> DataFrame:
    return features(table(spark, sf_dir, "sales"), table(spark, sf_dir, "clicks"), table(spark, sf_dir, "sale_lines"))


OP11_SQL = f"""
WITH steps AS (
  {CRC32_STEPS}
), probes AS (
  SELECT sale_id, client_id, sold_at, epoch_us(sold_at) + 1000000 * ({crc32('sale_id::VARCHAR')} % 259200) AS t
  FROM sales, steps WHERE client_id IS NOT NULL AND sold_at IS NOT NULL AND sale_id IS NOT NULL
), asked AS (
  SELECT *, 86400000000::BIGINT * d AS w FROM probes, (VALUES (2), (14)) AS v(d)
), c AS (
  SELECT a.sale_id, a.d, count(*) AS n_clicks, count(*) FILTER (WHERE kind = 'purchase') AS n_purchases, sum(coalesce(floor(100 * value + 0.5)::BIGINT, 0)) AS click_cents, arg_max(click_id, (epoch_us(ts), click_id)) AS last_click_id
  FROM asked a JOIN (SELECT DISTINCT * FROM clicks) k USING (client_id)
  WHERE a.t - w < epoch_us(ts) AND epoch_us(ts) <= a.t AND epoch_us(k.arrived_at) + 14400000000 <= a.t GROUP BY 1, 2
), s AS (
  SELECT a.sale_id, a.d, a.t, s.sale_id AS other, coalesce(floor(100 * total + 0.5)::BIGINT, 0) AS amount
  FROM asked a JOIN sales s USING (client_id)
  WHERE a.t - w < epoch_us(s.sold_at) AND epoch_us(s.sold_at) <= a.t AND epoch_us(s.arrived_at) + 14400000000 <= a.t
), sums AS (SELECT sale_id, d, count(*) AS n_sales, sum(amount) AS sale_cents FROM s GROUP BY 1, 2
), l AS (
  SELECT s.sale_id, d, count(*) AS n_lines, count(DISTINCT item_id) AS n_items, sum(coalesce(floor(100 * l.amount + 0.5)::BIGINT, 0)) AS line_cents
  FROM s JOIN sale_lines l ON l.sale_id = s.other WHERE epoch_us(shipped_at) <= s.t GROUP BY 1, 2
), labels AS (SELECT DISTINCT p.sale_id FROM probes p JOIN sales s USING (client_id) WHERE p.t < epoch_us(s.sold_at) AND epoch_us(s.sold_at) <= p.t + 604800000000)
SELECT a.sale_id, a.d, a.t AS t_us, y.sale_id IS NOT NULL AS label, coalesce(n_clicks, 0) AS n_clicks, coalesce(n_purchases, 0) AS n_purchases, coalesce(click_cents, 0)::BIGINT AS click_cents, last_click_id,
  coalesce(n_sales, 0) AS n_sales, coalesce(sale_cents, 0)::BIGINT AS sale_cents, coalesce(n_lines, 0) AS n_lines, coalesce(n_items, 0) AS n_items, coalesce(line_cents, 0)::BIGINT AS line_cents
FROM asked a LEFT JOIN c USING (sale_id, d) LEFT JOIN sums USING (sale_id, d) LEFT JOIN l USING (sale_id, d) LEFT JOIN labels y ON y.sale_id = a.sale_id
"""
