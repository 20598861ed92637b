"""Grids, algorithmic tasks and event windows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import grids, tasks
from ..session import table
from ..streaming import events
from .registry import query

_G = "g as (select vec_id, list_transform(range(8), lambda r: list_transform(range(8), lambda c: case when embedding[r * 8 + c + 1] > 0.1 then 1 + r % 3 when embedding[r * 8 + c + 1] < -0.2 then 5 else 0 end)) as g from embeddings)"
_TXT = "array_to_string(list_transform({0}, lambda row: array_to_string(row, ' ')), '/')"


def _grids(spark: SparkSession, d: str) -> DataFrame:
    cell = F.transform(F.sequence(F.lit(0), F.lit(7)), lambda r: F.transform(F.sequence(F.lit(0), F.lit(7)), lambda c: F.when(F.get("embedding", r * 8 + c).cast("double") > 0.1, 1 + r % 3).when(F.get("embedding", r * 8 + c).cast("double") < -0.2, 5).otherwise(0)))
    return table(spark, d, "embeddings").select("vec_id", cell.alias("g"))


def text(g: Column) -> Column:
    return F.array_join(F.transform(g, lambda row: F.array_join(F.transform(row, lambda x: x.cast("string")), " ")), "/")


_RANGE = "list_transform(range({0}), lambda r: list_transform(range({1}), lambda c: {2}))"
_GEO = {
    "rotate90": _RANGE.format(8, 8, "g[8 - c][r + 1]"),
    "rotate180": _RANGE.format(8, 8, "g[8 - r][8 - c]"),
    "rotate270": _RANGE.format(8, 8, "g[c + 1][8 - r]"),
    "mirror_x": _RANGE.format(8, 8, "g[8 - r][c + 1]"),
    "mirror_y": _RANGE.format(8, 8, "g[r + 1][8 - c]"),
    "swapped": _RANGE.format(8, 8, "case when g[r + 1][c + 1] = 5 then 9 else g[r + 1][c + 1] end"),
    "recolored": _RANGE.format(8, 8, "case g[r + 1][c + 1] when 1 then 2 when 2 then 1 else g[r + 1][c + 1] end"),
    "scaled": _RANGE.format(16, 16, "g[r // 2 + 1][c // 2 + 1]"),
    "tiled": _RANGE.format(16, 16, "g[r % 8 + 1][c % 8 + 1]"),
    "moved": _RANGE.format(8, 8, "case when r < 1 or c < 2 then 0 else g[r][c - 1] end"),
    "joined": "g",
    "intersected": _RANGE.format(8, 8, "case when g = list_reverse(g) then g[r + 1][c + 1] else 0 end"),
    "difference": _RANGE.format(8, 8, "case when g[8 - r][c + 1] <> 0 then 0 else g[r + 1][c + 1] end"),
}


@query(f"with {_G} select vec_id, " + ", ".join(f"{_TXT.format(v)} as {k}" for k, v in _GEO.items()) + " from g")
def grid_geometry(spark: SparkSession, d: str) -> DataFrame:
    g = _grids(spark, d)
    made = {
        "rotate90": grids.rotate90("g"),
        "rotate180": grids.rotate180("g"),
        "rotate270": grids.rotate270("g"),
        "mirror_x": grids.mirror_x("g"),
        "mirror_y": grids.mirror_y("g"),
        "swapped": grids.replace_color("g", 5, 9),
        "recolored": grids.recolor("g", {1: 2, 2: 1}),
        "scaled": grids.scale("g"),
        "tiled": grids.tile("g"),
        "moved": grids.translate("g", 1, 2, F.lit(0)),
        "joined": grids.union("g", grids.mirror_x("g")),
        "intersected": grids.intersection("g", grids.mirror_x("g")),
        "difference": grids.difference("g", grids.mirror_x("g")),
    }
    return g.select("vec_id", *[text(v).alias(k) for k, v in made.items()])


_CELLS = f"{_G}, cells as (select vec_id, r, c, g[r + 1][c + 1] as v from g, range(8) a(r), range(8) b(c)), bg as (select vec_id, v as bg from (select vec_id, v, row_number() over (partition by vec_id order by count(*) desc, min(r * 8 + c)) as k from cells group by vec_id, v) where k = 1), box as (select vec_id, bg, min(r) filter (v <> bg) as t, min(c) filter (v <> bg) as l, max(r) filter (v <> bg) as b, max(c) filter (v <> bg) as e from cells join bg using (vec_id) group by 1, 2)"


@query(f"with {_CELLS} select vec_id, bg::int as background, t::int as top, l::int as \"left\", b::int as bottom, e::int as \"right\", {_TXT.format('list_transform(range(t, b + 1), lambda r: g[r + 1][l + 1:e + 1])')} as cropped, {_TXT.format('[list_transform(range(10), lambda i: bg)] || list_transform(g, lambda row: [bg] || row || [bg]) || [list_transform(range(10), lambda i: bg)]')} as padded from box join g using (vec_id)")
def grid_boxes(spark: SparkSession, d: str) -> DataFrame:
    g = _grids(spark, d).withColumn("background", grids.background("g"))
    b = F.col("background")
    g = g.withColumn("box", grids.bounding_box("g", b))
    return g.select("vec_id", "background", *[F.col(f"box.{k}").alias(k) for k in ("top", "left", "bottom", "right")], text(grids.crop("g", b)).alias("cropped"), text(grids.pad("g", 1, b)).alias("padded"))


@query()
def grid_components(spark: SparkSession, d: str) -> DataFrame:
    """Areas of one colour, lines extended and holes filled; checked against plain re-statements in the tests."""
    g = _grids(spark, d).withColumn("sizes", grids.components("g"))
    return g.select("vec_id", F.size("sizes").alias("components"), F.array_max("sizes").alias("largest"), text(grids.extended("g")).alias("extended"), text(grids.filled("g")).alias("filled"))


def _tasks(spark: SparkSession, d: str) -> DataFrame:
    """One task a grid: two pairs under a transformation that its id picks."""
    g = _grids(spark, d)
    k = F.col("vec_id") % 4
    out = lambda c: F.when(k == 0, grids.rotate90(c)).when(k == 1, grids.mirror_y(c)).when(k == 2, grids.rotate180(grids.scale(c))).otherwise(grids.replace_color(c, 5, 7))
    g = g.withColumn("h", grids.mirror_x("g"))
    pair = lambda c: F.struct(F.col(c).alias("input"), out(c).alias("output"))
    g = g.withColumn("t", grids.mirror_y("g"))
    return g.select(F.col("vec_id").alias("task_id"), F.array(pair("g"), pair("h")).alias("train"), F.array(pair("t")).alias("test"))


@query()
def grid_programs(spark: SparkSession, d: str) -> DataFrame:
    r = grids.search(_tasks(spark, d))
    return r.select("task_id", "program", "solved", "tested", text(F.get("predictions", F.lit(0))).alias("prediction"))


#: Turning 5 into 7 is no step, so such a task is solved only where no cell is a 5; the other rules are steps.
@query(f"with {_G} select count(*) as tasks, avg(case when vec_id % 4 = 3 and list_contains(flatten(g), 5) then 0 else 1 end) as pass_at_1 from g")
def grid_pass_rate(spark: SparkSession, d: str) -> DataFrame:
    return grids.pass_rate(grids.search(_tasks(spark, d)))


_I = "i as (select vec_id, list_transform(embedding, lambda x: (abs(x::double) * 1000)::int % 16) as v, list_transform(embedding, lambda x: case when x > 0 then 24 else 25 end) as b from (select vec_id, list_transform(embedding, lambda x: floor(abs(x::double) * 1000) / 1000 * case when x > 0 then 1 else -1 end) as embedding from embeddings))"
_S = "array_to_string({0}, ' ')"


@query(
    f"with {_I} select vec_id, {_S.format('v')} as copy, {_S.format('list_reverse(v)')} as reverse, (list_sum(v)::bigint % 2)::varchar as parity, ((v[1] + v[2]) % (v[3] + 2))::varchar as modular_addition, {_S.format('list_sort(v)')} as sorting, {_S.format('list_transform(list_filter(range(32), lambda i: v[2 * i + 1] % 2 = 1), lambda i: v[2 * i + 2])')} as selective_copy, (list_sum(list_transform(v, lambda x: x % 2))::bigint % 2)::varchar as finite_state_parity from i"
)
def task_answers(spark: SparkSession, d: str) -> DataFrame:
    v = F.transform("embedding", lambda x: (F.floor(F.abs(x.cast("double")) * 1000)).cast("int") % 16)
    i = table(spark, d, "embeddings").select("vec_id", v.alias("v"))
    join = lambda c: F.array_join(F.transform(c, lambda x: x.cast("string")), " ")
    picks = F.transform("v", lambda x, k: F.when(k % 2 == 0, x % 2).otherwise(x))
    mod = F.array(F.get("v", F.lit(0)), F.get("v", F.lit(1)), F.get("v", F.lit(2)) + 2)
    inputs = {t: F.col("v") for t in ("copy", "reverse", "parity", "sorting", "finite_state_parity")} | {"selective_copy": picks, "modular_addition": mod}
    return i.select("vec_id", *[join(tasks.answer(t, c)).alias(t) for t, c in inputs.items()])


@query(
    "with u as (select vec_id, generate_subscripts(embedding, 1) as i, case when unnest(embedding) > 0 then 1 else -1 end as s from embeddings), r as (select vec_id, i, s, sum(s) over (partition by vec_id order by i) as depth from u) select vec_id, min(depth) >= 0 and sum(s) = 0 as balanced, (min(depth))::int as lowest from r group by vec_id"
)
def task_brackets(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "embeddings").select("vec_id", F.transform("embedding", lambda x: F.when(x > 0, tasks.OPEN).otherwise(tasks.CLOSE)).alias("b"))
    depth = lambda n: F.aggregate(F.slice("b", 1, n), F.lit(0), lambda s, x: s + F.when(x == tasks.OPEN, 1).otherwise(-1))
    return e.select("vec_id", tasks.is_balanced("b").alias("balanced"), F.array_min(F.transform(F.sequence(F.lit(1), F.size("b")), depth)).alias("lowest"))


@query()
def task_generation(spark: SparkSession, d: str) -> DataFrame:
    """A thousand seeded examples of each task."""
    out = None
    for t in tasks.TASKS:
        g = tasks.generate(spark, t, 1000, 8, 3).select("task", "example", F.size("prompt").alias("prompt_tokens"), F.size("answer").alias("answer_tokens"))
        out = g if out is None else out.union(g)
    return out


@query("select time_bucket(interval '1 hour', ts) as start, event_type, count(*) as n, round(sum(value), 6) as total from events group by 1, 2")
def event_windows(spark: SparkSession, d: str) -> DataFrame:
    """The streaming windows over the whole event table, as a batch."""
    w = events.windowed(table(spark, d, "events"), "ts", "value", "event_type", every="1 hour")
    return w.withColumn("total", F.round("total", 6))


@query("with g as (select user_id, ts, coalesce(ts - lag(ts) over (partition by user_id order by ts) >= interval '30 minutes', true) as fresh from events), s as (select user_id, ts, sum(fresh::int) over (partition by user_id order by ts) as k from g) select user_id, min(ts) as start, max(ts) + interval '30 minutes' as \"end\", count(*) as n from s group by user_id, k")
def event_sessions(spark: SparkSession, d: str) -> DataFrame:
    return events.sessions(table(spark, d, "events"), "ts", "user_id")
