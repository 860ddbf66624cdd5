r"""Near-duplicate documents by chosen-path set-similarity join.

A document's set holds its distinct shingles of ``width`` words (with fewer words,
the whole sequence as one); documents with equal sets share one node of the join.
Each node has 64 minwise tokens. A tree branches nodes by the value of a token that
the path chooses, on average into 1 / similarity children a level, so that similar
nodes stay together; independent trees repeat this until a link is found with the
wanted probability.

1. In every tree's first level, each group is compared with its first member. What
   is confirmed on the full sets is joined into components.
2. Only links between different components are left to find. A group with few
   members outside its largest component compares these with all its members, by
   their sketches and in blocks of bounded size; any other group branches again, down
   to ``DEPTH`` levels, where what is left is compared as well. Members that may be
   linked with another component go on, each once a group, to a comparison of full
   sets in blocks, which gives out links between components that it has not joined
   yet: a forest, never more links than members. A pair that meets in
   several groups is compared in the first tree whose group is compared whole. Before full
   sets are sent to blocks, groups around one component become one group, with each
   member once, where that takes fewer rows than the groups of all trees apart.

Candidates pass a 256-bit sketch of the minwise tokens, with a margin of five
standard deviations, and a bound on set sizes; then the full sets decide, as 64-bit
keys of shingles.

A null or empty text has no set and links with nothing. Repeated rows are equal
sets; a null key takes part in links and is never a component's name. Keys are
whole numbers (others raise an error in ANSI mode). Empty tables give no rows. Columns
besides key and text aren't read.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillgrade.llm.common import BROADCAST_BYTES, BROADCAST_ROWS, chunks, discard, fresh, gather, materialise, sent_if_small, sliced, utf8
from quillgrade.llm.flatwords import unit_keys

TOKENS = 64
TREES = 12
SMALL = 1024
BLOCK = 512
DEPTH = 10
BLOCK_SHINGLES = 500_000
CHUNK_BYTES = 1_000_000

_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True
_RNG = np.random.default_rng(8_5)
_TIMES = _RNG.integers(1, 2**63, TOKENS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_PLUS = _RNG.integers(0, 2**63, TOKENS, dtype=np.uint64)
_PLACE = _RNG.integers(1, 2**63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingle_sets(texts: list[bytes], width: int) -> list[np.ndarray]:
    """Each text's distinct shingles, as sorted 64-bit keys."""
    data = np.frombuffer((b"\n".join(texts) + b"\n").translate(_LOWER), dtype=np.uint8)
    space = _SPACE[data]
    start = np.flatnonzero(~space & np.r_[True, space[:-1]])
    ends = np.cumsum([len(t) + 1 for t in texts])
    first = np.searchsorted(start, np.r_[0, ends])
    if not len(start):
        return [np.zeros(0, np.uint64)] * len(texts)
    keys = _mix(unit_keys(data, start, space))
    span = max(0, len(keys) - width + 1)
    rolled = np.full(span, width, dtype=np.uint64)
    for i in range(width):
        rolled += keys[i : i + span] * _PLACE[i % 64]
    rolled = _mix(rolled)
    out = []
    for a, b in zip(first[:-1].tolist(), first[1:].tolist()):
        if b - a >= width:
            out.append(np.unique(rolled[a : b - width + 1]))
        elif b > a:
            whole = np.uint64(b - a) + (keys[a:b] * _PLACE[: b - a]).sum(dtype=np.uint64)
            out.append(_mix(np.array([whole], dtype=np.uint64)))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def minwise(sets: list[np.ndarray]) -> np.ndarray:
    """The minwise tokens of non-empty sets, one row each."""
    sizes = np.array([len(s) for s in sets], dtype=np.int64)
    flat, at = np.concatenate(sets), np.cumsum(sizes) - sizes
    out = np.empty((len(sets), TOKENS), dtype=np.uint32)
    for k in range(TOKENS):
        out[:, k] = np.minimum.reduceat((flat * _TIMES[k] + _PLUS[k]) >> np.uint64(32), at)
    return out


def sketch(tokens: np.ndarray) -> np.ndarray:
    """Four bits of each token, sixteen tokens in a 64-bit integer."""
    bits = ((tokens * np.uint32(2654435769)) >> np.uint32(28)).astype(np.uint64).reshape(len(tokens), 4, 16)
    return (bits << (np.arange(16, dtype=np.uint64) * np.uint64(4))).sum(axis=2, dtype=np.uint64).view(np.int64)


def _features(docs: DataFrame, key: str, text: str, width: int) -> DataFrame:
    def run(batches):
        for batch in sliced(batches):
            texts = [b"" if t is None else t for t in utf8(batch.column(1))]
            for a, b in chunks([len(t) for t in texts], CHUNK_BYTES):
                sets = shingle_sets(texts[a:b], width)
                some = [i for i, s in enumerate(sets) if len(s)]
                tokens, marks = [None] * len(sets), np.zeros((len(sets), 4), dtype=np.int64)
                if some:
                    found = minwise([sets[i] for i in some])
                    marks[some] = sketch(found)
                    for i, t in zip(some, found.view(np.int32)):
                        tokens[i] = t
                made = {
                    "key": batch.column(0).slice(a, b - a),
                    "text_hash": batch.column(2).slice(a, b - a),
                    "n": pa.array([len(s) for s in sets], pa.int64()),
                    "set_hash": pa.array([xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None for s in sets], pa.binary()),
                    "tokens": pa.array(tokens, pa.list_(pa.int32())),
                } | {f"s{i}": pa.array(marks[:, i], pa.int64()) for i in range(4)}
                yield pa.RecordBatch.from_pydict(made)

    return docs.select(F.col(key).cast("long"), F.col(text), F.xxhash64(text)).mapInArrow(run, "key long, text_hash long, n long, set_hash binary, tokens array<int>, s0 long, s1 long, s2 long, s3 long")


def _sets(docs: DataFrame, key: str, text: str, width: int) -> DataFrame:
    def run(batches):
        for batch in sliced(batches):
            texts = [b"" if t is None else t for t in utf8(batch.column(1))]
            for a, b in chunks([len(t) for t in texts], CHUNK_BYTES):
                sets = shingle_sets(texts[a:b], width)
                yield pa.RecordBatch.from_pydict(
                    {
                        "key": batch.column(0).slice(a, b - a),
                        "set_hash": pa.array([xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None for s in sets], pa.binary()),
                        "shingles": pa.array([s.view(np.int64) for s in sets], pa.list_(pa.int64())),
                    }
                )

    return docs.select(F.col(key).cast("long"), F.col(text)).mapInArrow(run, "key long, set_hash binary, shingles array<long>")


def _sent(rows: DataFrame) -> DataFrame:
    return sent_if_small(rows, BROADCAST_ROWS, BROADCAST_BYTES)


SKETCH = ["s0", "s1", "s2", "s3"]


def _least(percent: int) -> int:
    """Equal sketch parts that a linked pair has, less five standard deviations."""
    p = percent / 100 + (1 - percent / 100) / 16
    return math.floor(TOKENS * p - 5 * math.sqrt(TOKENS * p * (1 - p)))


def _alike(x: str, y: str, percent: int):
    """Whether two nodes may be linked, by their sizes and sketches."""
    differ = F.lit(0)
    for s in SKETCH:
        d = F.col(f"{x}.{s}").bitwiseXOR(F.col(f"{y}.{s}"))
        d = d.bitwiseOR(F.shiftrightunsigned(d, 2))
        d = d.bitwiseOR(F.shiftrightunsigned(d, 1))
        differ = differ + F.bit_count(d.bitwiseAND(F.lit(0x1111111111111111)))
    sizes = F.least(f"{x}.n", f"{y}.n") * 100 >= F.greatest(f"{x}.n", f"{y}.n") * percent
    return sizes & (TOKENS - differ >= _least(percent))


def _may_link(x: dict, every: dict, percent: int) -> np.ndarray:
    """Equal sketch parts of every pair, 0 where labels or sizes rule a link out."""
    ones = np.uint64(0x1111111111111111)
    same = np.full((len(x["uid"]), len(every["uid"])), TOKENS, dtype=np.int16)
    for s in SKETCH:
        d = x[s][:, None].view(np.uint64) ^ every[s].view(np.uint64)
        d |= d >> np.uint64(2)
        d |= d >> np.uint64(1)
        same -= np.bitwise_count(d & ones)
    small, large = np.minimum(x["n"][:, None], every["n"]), np.maximum(x["n"][:, None], every["n"])
    same[(x["label"][:, None] == every["label"]) | (small * 100 < large * percent)] = 0
    return same


def _pairs(x: dict, every: dict, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows of ``x`` and ``every`` of another label that may be linked, but for pairs that the group of an earlier tree compares."""
    row, col = np.nonzero(_may_link(x, every, percent) >= _least(percent))
    first = np.ones(len(row), dtype=bool)
    for t in range(x["tokens"].shape[1]):
        elsewhere = (x["tree"][row] > t) & ((x["whole"][row] >> t) & 1 == 1)
        first &= ~(elsewhere & (x["tokens"][row, t] == every["tokens"][col, t]))
    return row[first], col[first]


def _links(few: dict, every: dict, percent: int) -> np.ndarray:
    """Confirmed links of members of ``few`` that join labels not yet joined by the ones before: a forest."""
    sizes = np.array([len(s) for s in every["shingles"]])
    flat, at = np.concatenate(every["shingles"]).view(np.uint64), np.cumsum(sizes) - sizes  # sets are sorted as unsigned
    names, own = np.unique(np.r_[every["label"], few["label"]], return_inverse=True)
    root, own, own_few = np.arange(len(names)), own[: len(sizes)], own[len(sizes) :]
    out = []
    for i in range(0, len(few["uid"]), 64):
        row, col = _pairs({k: v[i : i + 64] for k, v in few.items()}, every, percent)
        edges = np.searchsorted(row, np.arange(65))
        for j in np.unique(row).tolist():
            may = col[edges[j] : edges[j + 1]]
            may = may[root[own[may]] != root[own_few[i + j]]]
            if not len(may):
                continue
            x = few["shingles"][i + j].view(np.uint64)
            y = flat[gather(at[may], sizes[may])]
            same = x[np.minimum(np.searchsorted(x, y), len(x) - 1)] == y
            common = np.add.reduceat(same, np.cumsum(sizes[may]) - sizes[may], dtype=np.int64)
            hit = may[100 * common >= percent * (len(x) + sizes[may] - common)]
            joined, first = np.unique(root[own[hit]], return_index=True)
            out += [(int(few["uid"][i + j]), int(every["uid"][h])) for h in hit[first]]
            root[np.isin(root, joined)] = root[own_few[i + j]]
    return np.array(out, dtype=np.int64).reshape(-1, 2)


def _by_block(rows: DataFrame, plain: list[str], nested: list[str], schema: str, work):
    """Applies ``work`` to each block of a group: its few members and all others, as arrays. Blocks are of bounded size."""
    names = ["path", "block", "few", *plain, *nested]
    rows = rows.select(*names).repartition("path", "block").sortWithinPartitions("path", "block", "few")

    def run(batches):
        held = None

        def done(group):
            f = group["few"] == 1
            if not f.any() or f.all():
                return None
            few, every = ({k: group[k][m] for k in names[3:]} for m in (f, ~f))
            for side in (few, every):
                side["tokens"] = np.stack(side["tokens"])
            return work(group["path"][0], few, every)

        for batch in batches:
            now = {k: batch.column(i).to_numpy(zero_copy_only=False) for i, k in enumerate(names)}
            if held is not None:
                now = {k: np.concatenate([held[k], now[k]]) for k in names}
            n = len(now["path"])
            fresh = np.flatnonzero((np.diff(now["path"]) != 0) | (np.diff(now["block"]) != 0)) + 1
            edges = [0, *fresh.tolist()] if n else []
            for a, b in zip(edges[:-1], edges[1:]):
                out = done({k: v[a:b] for k, v in now.items()})
                if out is not None:
                    yield out
            held = {k: v[edges[-1] :] for k, v in now.items()} if n else None
        out = done(held) if held is not None else None
        if out is not None:
            yield out

    return rows.mapInArrow(run, schema)


def _blocks(own: DataFrame, blocks, few_blocks) -> DataFrame:
    """A grid over each group: every block of members meets every block of the few outside the largest component."""
    f, e = few_blocks, blocks
    every = own.withColumn("__e", F.pmod(F.xxhash64("uid"), e)).withColumn("__f", F.explode(F.sequence(F.lit(0), f - 1))).withColumn("few", F.lit(0))
    few = own.where("label <> main").withColumn("__f", F.pmod(F.xxhash64("uid", F.lit(1)), f)).withColumn("__e", F.explode(F.sequence(F.lit(0), e - 1))).withColumn("few", F.lit(1))
    both = every.withColumn("__e", F.col("__e").cast("int")).unionByName(few.withColumn("__f", F.col("__f").cast("int")))
    return both.withColumn("block", F.xxhash64("__e", "__f"))


MEMBER = ["uid", "label", "n", *SKETCH, "tree", "whole"]


def _crossing(own: DataFrame, percent: int) -> DataFrame:
    """The members of groups that may be linked with a member of another component, each once a group."""

    def work(path, few, every):
        rows, cols = [], []
        for i in range(0, len(few["uid"]), 64):
            row, col = _pairs({k: v[i : i + 64] for k, v in few.items()}, every, percent)
            rows.append(np.unique(row) + i)
            cols.append(np.unique(col))
        held = {}
        for side, found in ((few, np.concatenate(rows)), (every, np.unique(np.concatenate(cols)))):
            for i in found.tolist():
                held.setdefault(int(side["uid"][i]), (side, i))
        if not held:
            return None
        made = {k: pa.array([side[k][i] for side, i in held.values()]) for k in MEMBER}
        tokens = np.stack([side["tokens"][i] for side, i in held.values()])
        return pa.RecordBatch.from_pydict({"path": pa.array(np.full(len(held), path)), "main": pa.array([side["main"][i] for side, i in held.values()])} | made | {"tokens": pa.array(list(tokens), pa.list_(pa.int32()))})

    rows = _blocks(own, F.ceil(F.col("c") / BLOCK).cast("int"), F.greatest(F.lit(1), F.ceil(F.col("few") / BLOCK)).cast("int"))
    schema = "path long, main long, uid long, label long, n long, s0 long, s1 long, s2 long, s3 long, tree int, whole long, tokens array<int>"
    return _by_block(rows, ["main", *MEMBER], ["tokens"], schema, work).dropDuplicates(["path", "uid"])


def _grid(own: DataFrame) -> DataFrame:
    """The numbers of blocks, ``e`` of members and ``f`` of the few outside the largest component, of each group, and the rows that they take."""
    other = F.col("label") != F.col("main")
    sums = own.groupBy("main", "path").agg(F.count("*").alias("c"), F.sum("n").alias("volume"), F.count_if(other).alias("others"), F.sum(F.when(other, F.col("n")).otherwise(0)).alias("few_volume"))
    parts = lambda c, volume: F.greatest(F.lit(1), F.ceil(F.col(c) / BLOCK), F.ceil(F.col(volume) / BLOCK_SHINGLES)).cast("int")
    sums = sums.withColumn("e", parts("c", "volume")).withColumn("f", parts("others", "few_volume"))
    return sums.select("main", "path", "e", "f", (F.col("c") * F.col("f") + F.col("others") * F.col("e")).alias("rows"))


def _families(own: DataFrame) -> DataFrame:
    """The members of groups with their grid; groups with one largest component are one, each member once, where this takes fewer rows.

    The trees' groups of one family of near copies have most members in common. All pairs
    of such a group meet in the joint one, so none is left to another tree.
    """
    once = own.withColumn("path", F.xxhash64("main", F.lit("family"))).withColumn("tree", F.lit(0)).dropDuplicates(["path", "uid"])
    apart, joint = materialise(_grid(own), "apart"), materialise(_grid(once), "joint")
    fewer = apart.groupBy("main").agg(F.sum("rows").alias("all")).join(joint, "main").where("rows < all").select("main")
    fewer = _sent(materialise(fewer, "families"))
    grid = joint.join(fewer, "main", "left_semi").union(apart.join(fewer, "main", "left_anti"))
    grid = materialise(grid.select("path", "e", "f"), "grid")
    return once.unionByName(own).join(_sent(grid), "path")


def _full(own: DataFrame, nodes: DataFrame, docs: DataFrame, key: str, text: str, width: int, percent: int) -> DataFrame:
    """Confirmed links between the components of groups, on full sets: a forest of each block."""
    sets = _sets_of(materialise(own.select("uid").distinct(), "uids"), nodes, docs, key, text, width)
    rows = _blocks(_families(own), F.col("e"), F.col("f"))
    rows = rows.join(sets, "uid")

    def work(path, few, every):
        found = _links(few, every, percent)
        return pa.RecordBatch.from_pydict({"a": pa.array(found[:, 0]), "b": pa.array(found[:, 1])}) if len(found) else None

    return _by_block(rows, MEMBER, ["shingles", "tokens"], "a long, b long", work)


def _sets_of(uids: DataFrame, nodes: DataFrame, docs: DataFrame, key: str, text: str, width: int) -> DataFrame:
    """(uid, shingles) of the wanted nodes, from one document of each; only documents with their keys are cut into shingles."""
    wanted = materialise(nodes.select("uid", "set_hash", F.col("rep").alias("w_key")).join(_sent(uids), "uid"), "wanted").withColumnsRenamed({"set_hash": "w_hash"})
    read = docs.select(F.col(key).cast("long").alias("key"), F.col(text).alias("text")).join(_sent(wanted.select("w_key")), F.col("key").eqNullSafe(F.col("w_key")), "left_semi")
    sets = _sets(read, "key", "text", width).join(_sent(wanted), (F.col("set_hash") == F.col("w_hash")) & F.col("key").eqNullSafe(F.col("w_key")))
    return materialise(sets.select("uid", "shingles"), "sets").dropDuplicates(["uid"])


def _confirm(pairs: DataFrame, nodes: DataFrame, docs: DataFrame, key: str, text: str, width: int, percent: int) -> DataFrame:
    """The pairs (a, b) whose full sets are similar enough."""
    pairs = materialise(pairs.distinct(), "pairs")
    uids = materialise(pairs.select(F.col("a").alias("uid")).union(pairs.select("b")).distinct(), "uids")
    sets = _sets_of(uids, nodes, docs, key, text, width)
    x, y = sets.select(F.col("uid").alias("b"), F.col("shingles").alias("y")), sets.select(F.col("uid").alias("a"), F.col("shingles").alias("x"))
    both = pairs.join(x, "b").join(y, "a").withColumn("common", F.size(F.array_intersect("x", "y")))
    return both.where(100 * F.col("common") >= percent * (F.size("x") + F.size("y") - F.col("common"))).select("a", "b")


def components(edges: DataFrame) -> DataFrame:
    """(uid, label): each linked node with the smallest node that it can reach.

    Each round takes the least label among neighbours and the label of that one, so
    that the rounds grow with the logarithm of the longest path.
    """
    both = materialise(edges.union(edges.select("b", "a")).toDF("uid", "other").distinct(), "edges")
    labels = materialise(both.groupBy("uid").agg(F.least("uid", F.min("other")).alias("label")), "labels")
    while True:
        known = _sent(labels)
        near = both.join(known.select(F.col("uid").alias("other"), "label"), "other").groupBy("uid").agg(F.min("label").alias("near"))
        least = near.join(known, "uid").select("uid", F.least("label", "near").alias("next"), F.col("label").alias("was"))
        jump = known.select(F.col("uid").alias("next"), F.col("label").alias("far"))
        moved = materialise(least.join(jump, "next").select("uid", F.least("next", "far").alias("label"), "was"), "labels")
        changed = moved.where("label <> was").count()
        discard(labels)
        labels = moved.select("uid", "label")
        if not changed:
            return labels


def _between(level: DataFrame, nodes: DataFrame, labels: DataFrame, percent: int, trees: int) -> DataFrame:
    """Members of groups that may be linked with another component, from the first level of groups down."""
    found = None
    known = _sent(labels)
    held = ["path", "uid", "n", *SKETCH, "tokens", "whole"]
    for depth in range(1, DEPTH + 1):
        own = level.join(known, "uid", "left").withColumn("label", F.coalesce("label", "uid"))
        parts = own.groupBy("path", "label").agg(F.count("*").alias("k"))
        groups = parts.groupBy("path").agg(F.sum("k").alias("c"), F.max(F.struct("k", "label")).alias("most"), F.count("*").alias("parts")).where("parts > 1")
        groups = groups.select("path", "c", F.col("most.label").alias("main"), (F.col("c") - F.col("most.k")).alias("few"))
        groups = materialise(groups.withColumn("small", (F.col("few") <= SMALL) | F.lit(depth == DEPTH)), "groups")
        own = own.join(_sent(groups), "path")
        branching = depth < DEPTH and groups.where("NOT small").count() > 0
        if depth == 1:  # bit t: the group of tree t is compared whole
            whole = F.sum(F.when(F.col("small"), F.expr("shiftleft(1L, tree)")).otherwise(0)).over(Window.partitionBy("uid"))
            own = own.withColumn("whole", whole if branching else F.lit(2**trees - 1).cast("long"))
        if branching:
            own = materialise(own, "own")
        members = materialise(_crossing(own.where("small"), percent), "crossing")
        found = members if found is None else found.unionByName(members)
        if not branching:
            break
        large = own.where("NOT small").select(*held)
        # each path chooses one token, and now and then a second one
        pick = lambda i: F.pmod(F.xxhash64("path", F.lit(i)), F.lit(TOKENS)).cast("int")
        also = F.pmod(F.xxhash64("path", F.lit(-1)), F.lit(1000)) < int(1000 * (100 / percent - 1))
        picks = F.when(also & (pick(0) != pick(1)), F.array(pick(0), pick(1))).otherwise(F.array(pick(0)))
        deeper = nodes.select("uid", F.col("tokens").alias("all")).join(large, "uid").select(*held, "all", F.explode(picks).alias("at"))
        deeper = deeper.withColumn("path", F.xxhash64("path", "at", F.element_at("all", F.col("at") + 1))).select(*held, F.lit(trees).alias("tree"))
        level = materialise(deeper, "deeper")
    return found


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", width: int = 3, percent: int = 85, trees: int = TREES) -> DataFrame:
    """A row each document: key, n_shingles, component_id (least key reachable) and kept (the key is the component's)."""
    features = materialise(_features(docs, key, text, width), "features")
    named = _components_of(features, docs, key, text, width, percent, trees)
    return named.select(F.col("key").alias(key), F.col("n").alias("n_shingles"), "component_id").withColumn("kept", F.col(key).eqNullSafe(F.col("component_id")))


def _components_of(features: DataFrame, docs: DataFrame, key: str, text: str, width: int, percent: int, trees: int) -> DataFrame:
    """The features' keys, text hashes and set sizes with the component of each."""
    nodes = features.where("n > 0").groupBy("set_hash").agg(F.min("key").alias("rep"), *[F.first(c).alias(c) for c in ("n", "tokens", *SKETCH)])
    nodes = materialise(nodes.withColumn("uid", F.monotonically_increasing_id()), "nodes")

    # first level: tree t branches by token t
    roots = nodes.select("uid", "n", *SKETCH, F.slice("tokens", 1, trees).alias("tokens"), F.posexplode(F.slice("tokens", 1, trees)).alias("tree", "token"))
    members = roots.select(F.xxhash64("tree", "token").alias("path"), "tree", "uid", "n", *SKETCH, "tokens")
    first = F.min(F.struct("uid", "n", *SKETCH)).alias("pivot")
    groups = members.groupBy("path").agg(F.count("*").alias("c"), first).where("c > 1")
    members = materialise(members.join(groups, "path"), "members")
    star = members.alias("m").where("uid <> pivot.uid")
    star = star.select(F.col("pivot.uid").alias("a"), F.col("uid").alias("b"), F.struct("n", *SKETCH).alias("x"), F.col("pivot").alias("y")).where(_alike("x", "y", percent)).select("a", "b")
    edges = materialise(_confirm(star, nodes, docs, key, text, width, percent), "star-edges")
    labels = components(edges)

    # groups that hold more than one component
    found = _between(members.select("path", "tree", "uid", "n", *SKETCH, "tokens"), nodes, labels, percent, trees)
    found = materialise(_full(found, nodes, docs, key, text, width, percent), "cross-edges")
    if found.count():
        labels = components(edges.union(found))

    linked = materialise(nodes.select("uid", "rep").join(_sent(labels), "uid"), "linked")
    names = linked.groupBy("label").agg(F.min("rep").alias("component_id"))
    linked = materialise(linked.join(names, "label").select("uid", "component_id"), "named")
    named = nodes.select("uid", "set_hash", "rep").join(_sent(linked), "uid", "left").select("set_hash", F.when(F.col("component_id").isNull(), F.col("rep")).otherwise(F.col("component_id")).alias("component_id"))
    out = features.select("key", "text_hash", "n", "set_hash").join(named, "set_hash", "left")
    return out.select("key", "text_hash", "n", F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("key")).alias("component_id"))


def keep_one(docs: DataFrame, key: str = "doc_id", text: str = "text", width: int = 5, percent: int = 80, trees: int = TREES) -> DataFrame:
    """One document of each component, with its columns: the one with the least key.

    Rows that repeat key and text are one document and stay or go together; of rows
    with one key and different texts each is judged by its text. Rows without key go
    where their component has a key; without any key all rows of a component stay.
    """
    features = materialise(_features(docs, key, text, width), "features")
    named = _components_of(features, docs, key, text, width, percent, trees)
    names = fresh(docs, "gone"), fresh(docs, "gone_hash")
    gone = named.where("NOT key <=> component_id").select(F.col("key").alias(names[0]), F.col("text_hash").alias(names[1])).distinct()
    gone = _sent(materialise(gone, "gone"))
    return docs.join(gone, docs[key].cast("long").eqNullSafe(gone[names[0]]) & (F.xxhash64(docs[text]) == gone[names[1]]), "left_anti")
