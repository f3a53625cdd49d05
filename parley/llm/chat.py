"""Chat formatting: a hidden Markov model recovers who speaks, then turns are rendered in one canonical form.

Units are the lines or turns of a transcript. What is seen of a unit is its speaker marker ("User:", "[assistant]",
"<|system|>" ... or none) and its form: length, number of lines, final question mark, whether it opens the transcript.
Roles are the hidden states; Viterbi finds the likeliest sequence. A marker is strong evidence, not a rule: a quoted
"User:" inside an answer loses against its neighbours. Transition and emission counts come from all labelled units by
DataFrame aggregation; unlabelled transcripts are never looked at for them.

Long transcripts: units are dealt in blocks of `block` positions. Each block's best scores from any state before it to
any state at its end form a small matrix; matrices are chained per transcript, which fixes the states at block bounds;
every block is then traced back on its own. The result is that of one Viterbi pass, and no task holds a transcript.

Defined cases: a null text is an empty unit; null ids are one transcript; null positions come first, ties in position
are ordered by text. Ties in probability go to the role that sorts first. Without labelled units there is no model and
every role is null. Markers are removed from the rendered text; nothing else is.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from parley.llm._common import materialize, q, spread_join

# What speakers are called at the start of a unit, by role.
NAMES = {
    "assistant": "assistant|ai|bot|model|answer|gpt|a",
    "system": "system|instructions?|sys|developer",
    "user": "user|human|customer|question|prompter|q",
}
_OPEN, _CLOSE = r"^\s*(?:<\|(?:im_start\|>)?|\[|\*\*|###\s*)?\s*", r"\s*(?:\|>|\]|\*\*)?\s*(?::\*\*|:|>|\|>|\])\s*"
MARKERS = {role: f"(?i){_OPEN}(?:{names}){_CLOSE}" for role, names in NAMES.items()}
#: Upper bounds of the length classes, in code points.
LENGTHS = (20, 60, 120, 200, 300, 450, 700, 1000, 1500)


def features(text: Column, opens: Column) -> dict[str, Column]:
    """What is seen of a unit, as small integers."""
    t = F.coalesce(text, F.lit(""))
    marker = F.lit(0)
    for k, role in enumerate(sorted(MARKERS, reverse=True)):
        marker = F.when(t.rlike(MARKERS[role]), len(MARKERS) - k).otherwise(marker)
    length = F.lit(len(LENGTHS))
    for k, most in reversed(list(enumerate(LENGTHS))):
        length = F.when(F.length(t) <= most, k).otherwise(length)
    lines = F.least(F.length(t) - F.length(F.replace(t, F.lit("\n"), F.lit(""))), F.lit(4))
    return {"marker": marker, "length": length, "lines": lines, "asks": F.rtrim(t).endswith("?").cast("int"), "opens": opens.cast("int")}


SIZES = {"marker": len(MARKERS) + 1, "length": len(LENGTHS) + 1, "lines": 5, "asks": 2, "opens": 2}


def unmarked(text: Column) -> Column:
    """The text without the speaker marker it starts with."""
    t = F.coalesce(text, F.lit(""))
    for pattern in MARKERS.values():
        t = F.when(t.rlike(pattern), F.regexp_replace(t, pattern, "")).otherwise(t)
    return t


@dataclass
class Model:
    roles: list[str]
    start: np.ndarray
    move: np.ndarray
    emit: dict[str, np.ndarray]

    def scores(self, seen: dict[str, np.ndarray]) -> np.ndarray:
        """Log-likelihood of each unit in each state."""
        return sum(self.emit[c][:, np.minimum(v, self.emit[c].shape[1] - 1)] for c, v in seen.items()).T


def units(rows: DataFrame, id_col: str, pos_col: str, text_col: str, block: int, role_col: str | None = None) -> DataFrame:
    """conv, pos, text, role, block and the features of each row. A transcript opens with its least position, whatever that is."""
    raw = rows.select(q(id_col).alias("conv"), q(pos_col).cast("long").alias("pos"), q(text_col).alias("text"), (q(role_col) if role_col else F.lit(None).cast("string")).alias("role"))
    least = materialize(raw.where("conv IS NOT NULL AND pos IS NOT NULL").groupBy("conv").agg(F.min("pos").alias("least"), F.count(F.lit(1)).alias("n")), "openings")
    total = least.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    raw = spread_join(raw, least, ["conv"], total, "n", how="left")
    first = F.col("pos").isNull() | (F.col("pos") <= F.coalesce("least", F.lit(0)))
    return raw.withColumn("first", first).drop("least").withColumn("block", F.floor(F.coalesce("pos", F.lit(-1)) / block).cast("long")).select("*", *(c.alias(k) for k, c in features(F.col("text"), F.col("first")).items())).drop("first")


def fit(labelled: DataFrame, id_col: str = "conv_id", pos_col: str = "turn", text_col: str = "text", role_col: str = "role", block: int = 256, weight: float = 0.5) -> Model:
    """Counts over all labelled units, each with `weight` added. Rows without a role are left out."""
    rows = units(labelled, id_col, pos_col, text_col, block, role_col).where("role IS NOT NULL")
    # the unit before, also over block bounds: the last position before a block belongs to the block before
    order = W.partitionBy("conv", "block").orderBy("pos", "text")
    inner = rows.withColumn("before", F.lag("role").over(order))
    last = rows.groupBy("conv", "block").agg(F.max(F.struct("pos", "text", "role")).alias("m")).select(F.col("conv").alias("c"), (F.col("block") + 1).alias("b"), F.col("m.role").alias("prev"))
    moves = inner.where("before IS NULL").join(last, F.col("conv").eqNullSafe(F.col("c")) & (F.col("block") == F.col("b")), "left").select("role", F.col("prev").alias("before"))
    moves = moves.unionByName(inner.where("before IS NOT NULL").select("role", "before")).groupBy("before", "role").count().collect()
    feature = F.explode(F.array(*(F.struct(F.lit(k).alias("k"), F.col(k).cast("int").alias("v")) for k in SIZES)))
    seen = rows.select("role", feature.alias("f")).groupBy("role", "f.k", "f.v").count().collect()  # roles x feature values
    roles = sorted({r["role"] for r in seen})
    at = {r: k for k, r in enumerate(roles)}
    start, move = np.full(len(roles), weight), np.full((len(roles), len(roles)), weight)
    for r in moves:
        if r["before"] is None:
            start[at[r["role"]]] += r["count"]
        else:
            move[at[r["before"]], at[r["role"]]] += r["count"]
    emit = {k: np.full((len(roles), n), 0.0 if k == "marker" else weight) for k, n in SIZES.items()}
    for r in seen:
        emit[r["k"]][at[r["role"]], r["v"]] += r["count"]
    # a marker speaks for its role even if no labelled unit carries one: a fifth of what is expected of a role's markers
    for x, role in enumerate(roles):
        told = np.array([0.0, *(0.999 if name == role else 0.0005 for name in sorted(MARKERS))])
        emit["marker"][x] = 0.8 * emit["marker"][x] / emit["marker"][x].sum() + 0.2 * told / told.sum()
    log = lambda m: np.log(m / m.sum(-1, keepdims=True)) if m.size else m
    return Model(roles, log(start), log(move), {k: log(m) for k, m in emit.items()})


def viterbi(model: Model, scores: np.ndarray, before: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
    """(best scores at the end, back pointers) from the scores before the first unit (None: nothing comes before)."""
    back = np.zeros(scores.shape, np.int8)
    v = None
    for t, s in enumerate(scores):
        if t == 0 and before is None:
            v = model.start + s
            continue
        ways = (before if t == 0 else v)[:, None] + model.move
        back[t] = ways.argmax(0)
        v = ways.max(0) + s
    return v, back


def _groups(batches: Iterator[pa.RecordBatch], keys: tuple[str, ...]) -> Iterator[pa.Table]:
    """Runs of rows with equal keys from sorted batches; a run is as long as a block (or a transcript's list of blocks)."""
    held: list[pa.RecordBatch] = []
    last = None
    for b in batches:
        ks = list(zip(*(b.column(k).to_pylist() for k in keys), strict=True))
        i = 0
        while i < len(ks):
            j = i
            while j < len(ks) and ks[j] == ks[i]:
                j += 1
            if ks[i] != last and held:
                yield pa.Table.from_batches(held)
                held = []
            held.append(b.slice(i, j - i))
            last, i = ks[i], j
    if held:
        yield pa.Table.from_batches(held)


def _seen(g: pa.Table) -> dict[str, np.ndarray]:
    return {k: g.column(k).to_numpy().astype(int) for k in SIZES}


def _pile(rows: list[dict], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_pylist(rows, schema=schema)


def recover_roles(rows: DataFrame, model: Model, id_col: str = "conv_id", pos_col: str = "turn", text_col: str = "text", role_col: str | None = None, block: int = 256) -> DataFrame:
    """conv, pos, text, role (if given, untouched), role_pred, rendered for each row."""
    n = len(model.roles)
    u = units(rows, id_col, pos_col, text_col, block, role_col)
    conv = u.schema["conv"].dataType.simpleString()
    form = lambda k, t: F.concat(F.lit("<|"), k, F.lit("|>\n"), t, F.lit("<|end|>\n"))
    if not n:
        return u.select("conv", "pos", "text", "role", F.lit(None).cast("string").alias("role_pred"), F.lit(None).cast("string").alias("rendered"))
    u = materialize(u, "units")
    dealt = u.repartition("conv", "block").sortWithinPartitions("conv", "block", F.col("pos").asc_nulls_first(), "text")

    def matrices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, schema = [], None
        for g in _groups(batches, ("conv", "block")):
            schema = schema or pa.schema([g.schema.field("conv"), ("block", pa.int64()), ("fresh", pa.list_(pa.float64())), ("matrix", pa.list_(pa.float64()))])
            s = model.scores(_seen(g))
            fresh = viterbi(model, s, None)[0]
            rows_of = [viterbi(model, s, np.where(np.arange(n) == k, 0.0, -math.inf))[0] for k in range(n)]
            out.append({"conv": g.column("conv")[0].as_py(), "block": g.column("block")[0].as_py(), "fresh": fresh.tolist(), "matrix": np.concatenate(rows_of).tolist()})
            if len(out) >= 5000:
                yield _pile(out, schema)
                out = []
        if out:
            yield _pile(out, schema)

    def bounds(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, schema = [], None
        for g in _groups(batches, ("conv",)):
            schema = schema or pa.schema([g.schema.field("conv"), ("block", pa.int64()), ("enter", pa.int32()), ("leave", pa.int32())])
            ms = [np.array(m).reshape(n, n) for m in g.column("matrix").to_pylist()]
            v, back = np.array(g.column("fresh")[0].as_py()), []
            for m in ms[1:]:
                ways = v[:, None] + m
                back.append(ways.argmax(0))
                v = ways.max(0)
            state, path = int(v.argmax()), []
            for b in [*reversed(back), None]:
                enter = -1 if b is None else int(b[state])
                path.append((enter, state))
                state = enter
            out += [{"conv": c, "block": b, "enter": e, "leave": x} for c, b, (e, x) in zip(g.column("conv").to_pylist(), g.column("block").to_pylist(), reversed(path), strict=True)]
            if len(out) >= 5000:
                yield _pile(out, schema)
                out = []
        if out:
            yield _pile(out, schema)

    def trace(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for g in _groups(batches, ("conv", "block")):
            s = model.scores(_seen(g))
            enter, state = g.column("enter")[0].as_py(), g.column("leave")[0].as_py()
            _, back = viterbi(model, s, None if enter < 0 else np.where(np.arange(n) == enter, 0.0, -math.inf))
            path = np.zeros(len(s), int)
            for t in range(len(s) - 1, -1, -1):
                path[t] = state
                state = back[t, state]
            names = pa.array(model.roles).take(pa.array(path))
            yield from pa.table([g.column("conv"), g.column("pos"), g.column("text"), g.column("role"), names], names=["conv", "pos", "text", "role", "role_pred"]).combine_chunks().to_batches()

    small = materialize(dealt.select("conv", "block", *SIZES).mapInArrow(matrices, f"conv {conv}, block long, fresh array<double>, matrix array<double>"), "block-scores")
    ends = small.repartition("conv").sortWithinPartitions("conv", "block").mapInArrow(bounds, f"conv {conv}, block long, enter int, leave int")
    ends = materialize(ends, "block-bounds").withColumnsRenamed({"conv": "c", "block": "b"})
    told = u.join(ends, F.col("conv").eqNullSafe(F.col("c")) & (F.col("block") == F.col("b"))).drop("c", "b")
    told = told.repartition("conv", "block").sortWithinPartitions("conv", "block", F.col("pos").asc_nulls_first(), "text")
    roles = told.mapInArrow(trace, f"conv {conv}, pos long, text string, role string, role_pred string")
    return roles.select("conv", "pos", "text", "role", "role_pred", form(F.col("role_pred"), unmarked(F.col("text"))).alias("rendered"))


def lines(transcripts: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """conv_id, turn, text: the lines of whole transcripts, for recover_roles(); blank lines are left out."""
    cut = transcripts.select(q(id_col).alias("conv_id"), F.posexplode(F.split(F.coalesce(q(text_col), F.lit("")), r"\r?\n")).alias("turn", "text"))
    return cut.where(F.trim("text") != "")


def merged(roles: DataFrame) -> DataFrame:
    """conv, turn, role_pred, rendered: neighbouring lines of one role as one turn, for transcripts whose lines were units.

    Islands of equal roles per transcript; meant for transcripts that fit a task (lines() gives one row's lines)."""
    order = W.partitionBy("conv").orderBy("pos", "text")
    new = F.when(F.lag("role_pred").over(order).eqNullSafe(F.col("role_pred")), 0).otherwise(1)
    turns = roles.withColumn("new", new).withColumn("turn", F.sum("new").over(order) - 1)
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "text"))), lambda x: unmarked(x["text"])), "\n")
    out = turns.groupBy("conv", "turn", "role_pred").agg(joined.alias("text"))
    return out.select("conv", "turn", "role_pred", F.concat(F.lit("<|"), "role_pred", F.lit("|>\n"), "text", F.lit("<|end|>\n")).alias("rendered"))
