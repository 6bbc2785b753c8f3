"""Hard negatives by lists that all anchors of a cluster share, walked until what is left is certainly too low.

Anchors are clustered by direction. For a cluster with centre c whose members are at most an angle w from it, a row r
scores at most |a| g with any member a, where g = |r| cos(max(0, angle(r, c) - w)). Each cluster's list holds all rows
by falling g, sorted once, in blocks; every member walks it block by block, scoring what it meets, and stops for good
once |a| g of the next block is below the last place that it has to fill. Scores are whole numbers and exact; the bound is
rounded up, so a stop is certain, whatever the centres are. The walk is done twice: among rows of the anchor's label for its
positives, then among the others, whose places lie in a band below each positive's score.

Rows of one label and one vector are one entry with the few smallest ids that can be returned, so copies cost one entry.
Members that walk on are packed anew before each step, and the steps grow by `GROWTH` blocks, so the number of Spark jobs is
the logarithm of a list's length.

Edge cases: rows with a null id, label or vector, or a null or non-finite component, take no part; shorter vectors are
filled up with zeros; repeated rows count once; rows with one id but different labels or vectors are different rows, and as
anchors both give rows; ties go to the smaller id; an anchor without positives, or whose positives score below 0, gives no rows; a zero vector scores 0 with all rows; no rows give
no rows; other columns are ignored. Components must stay below 2^31 and scores below 2^62 in absolute value.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stagetrail.llm.common import staged

POSITIVES, NEGATIVES = 5, 3
#: A negative's score, times 100, lies from `LEAST` to `MOST` times its positive's.
LEAST, MOST = 50, 95
SCALE = 256
#: Centres are fitted on about `SAMPLE` anchors (all, if fewer), chosen by a hash of the id; the rest is exact.
CLUSTERS, SAMPLE, ROUNDS = 8, 4096, 12
#: Entries of a list's block, members of a block of anchors, growth of a step.
BLOCK, MEMBERS, GROWTH = 1024, 512, 4
#: Parts of a list into which a step is dealt.
LANES = 16


def usable_rows(vectors: DataFrame, anchor: Column, scale: int = SCALE) -> DataFrame:
    """vec_id, label, vector (whole numbers, all of one length) and anchor (boolean) of the rows that take part."""
    valid = F.forall("embedding", lambda x: x.isNotNull() & (F.abs(x.cast("double")) < float("inf")))
    rows = vectors.withColumn("anchor", anchor).filter("vec_id is not null and label is not null and embedding is not null").filter(valid)
    whole = F.transform("embedding", lambda x: F.floor(x.cast("double") * scale).cast("long"))
    rows = rows.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"), whole.alias("vector"), "anchor")
    longest = rows.agg(F.max(F.size("vector"))).first()[0] or 0
    filled = F.concat("vector", F.array_repeat(F.lit(0).cast("long"), F.lit(longest) - F.size("vector")))
    return rows.withColumn("vector", filled).distinct()


def entries(rows: DataFrame) -> DataFrame:
    """entry (a number), label, vector and ids (the smallest that may be returned, in order)."""
    # As many as can be returned and the anchor itself. Spark ranks in each task before it shuffles.
    place = F.row_number().over(Window.partitionBy("label", "vector").orderBy("vec_id"))
    some = rows.withColumn("place", place).filter(F.col("place") <= max(POSITIVES, NEGATIVES) + 1)
    made = some.groupBy("label", "vector").agg(F.sort_array(F.collect_list("vec_id")).alias("ids"))
    return made.select(F.monotonically_increasing_id().alias("entry"), "*")


def _matrix(column):
    """The rows of an Arrow column of equally long lists."""
    import numpy as np

    return np.asarray(column.values.to_numpy(zero_copy_only=False)[column.offsets[0].as_py() : column.offsets[-1].as_py()], np.int64).reshape(len(column), -1)


def _directions(matrix):
    import numpy as np

    norm = np.sqrt((matrix.astype(float) ** 2).sum(axis=1))
    return matrix / np.maximum(norm, 1e-300)[:, None], norm


def centres(anchors: DataFrame, clusters: int = CLUSTERS):
    """Unit vectors, by spherical k-means over the sample. Only bounds depend on them, no result."""
    import numpy as np

    n = anchors.count()
    share = F.pmod(F.xxhash64(F.lit("centre"), "label", "vector"), F.lit(1 << 52)) < int((1 << 52) * min(1.0, SAMPLE / max(1, n)))
    found = anchors.filter(share).orderBy("label", "vector").select("vector").toArrow()
    if not found.num_rows:
        return None
    points, _ = _directions(_matrix(found["vector"].combine_chunks()))
    made = points[[0]]
    while len(made) < min(clusters, len(points)):
        made = np.vstack([made, points[[(points @ made.T).max(axis=1).argmin()]]])
    for _ in range(ROUNDS):
        own = (points @ made.T).argmax(axis=1)
        sums = np.stack([points[own == k].sum(axis=0) for k in range(len(made))])
        made = np.where((own[:, None] == np.arange(len(made))).any(axis=0)[:, None], _directions(sums)[0], made)
    return made


def clustered(anchors: DataFrame, centre) -> DataFrame:
    """`anchors` with cluster, angle and norm."""

    def assign(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        for batch in batches:
            unit, norm = _directions(_matrix(batch.column("vector")))
            near = unit @ centre.value.T
            own = near.argmax(axis=1)
            angle = np.where(norm > 0, np.arccos(np.clip(near.max(axis=1, initial=-1), -1, 1)), 0.0)
            yield pa.record_batch([*batch.columns, pa.array(own.astype(np.int32)), pa.array(angle), pa.array(norm)], [*batch.schema.names, "cluster", "angle", "norm"])

    return anchors.mapInArrow(assign, "entry long, label long, vector array<long>, cluster int, angle double, norm double")


def lists(rows: DataFrame, centre, widths: list[float | None], block: int = BLOCK) -> DataFrame:
    """A row per block of a cluster's list: cluster, high and low (its bounds), rows (packed labels, ids and vectors)."""

    def bounded(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        for batch in batches:
            unit, norm = _directions(_matrix(batch.column("vector")))
            angles = np.arccos(np.clip(unit @ centre.value.T, -1, 1))
            for k, width in enumerate(widths):
                if width is not None:
                    # Past a half turn the cosine would rise again; rounding is made up for.
                    g = norm * np.cos(np.clip(angles[:, k] - width - 1e-6, 0, np.pi))
                    yield pa.record_batch([pa.array(np.full(batch.num_rows, k, np.int32)), pa.array(g), *(batch.column(c) for c in ("entry", "label", "ids", "vector"))], ["cluster", "g", "entry", "label", "ids", "vector"])

    def packed(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        def blocks(cluster, part):
            for at in range(0, part.num_rows, block):
                some = part.slice(at, block).combine_chunks()
                g = some["g"].to_numpy()
                yield cluster, float(g.max()), float(g.min()), pa.BufferOutputStream(), some.select(["entry", "label", "ids", "vector"])

        def written(found):
            made = []
            for cluster, high, low, sink, some in found:
                with pa.ipc.new_stream(sink, some.schema) as out:
                    out.write_table(some)
                made.append((cluster, high, low, sink.getvalue().to_pybytes()))
            columns = zip(*made, strict=True) if made else ([], [], [], [])
            return pa.record_batch([pa.array(c, t) for c, t in zip(columns, (pa.int32(), pa.float64(), pa.float64(), pa.binary()), strict=True)], ["cluster", "high", "low", "rows"])

        rest = None
        for batch in batches:
            rest = pa.Table.from_batches([batch]) if rest is None else pa.concat_tables([rest, pa.Table.from_batches([batch])])
            own = rest["cluster"].to_numpy()
            ends = np.flatnonzero(np.diff(own)) + 1
            starts = [0, *ends.tolist()]
            for a, b in zip(starts, [*starts[1:], rest.num_rows], strict=True):
                whole = b if b < rest.num_rows else a + (b - a) // block * block
                if whole > a:
                    yield written(blocks(int(own[a]), rest.slice(a, whole - a)))
                if b == rest.num_rows:
                    rest = rest.slice(whole) if whole < b else None
        if rest is not None and rest.num_rows:
            yield written(blocks(int(rest["cluster"][0].as_py()), rest))

    listed = rows.select("entry", "label", "ids", "vector").mapInArrow(bounded, "cluster int, g double, entry long, label long, ids array<long>, vector array<long>")
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    listed = listed.withColumn("last", -F.col("g")).repartitionByRange(parts, "cluster", "last").sortWithinPartitions("cluster", "last").drop("last")
    return listed.mapInArrow(packed, "cluster int, high double, low double, rows binary")


def _packed_members(members: DataFrame, fields: list[str]) -> DataFrame:
    """cluster and members (packed), at most `MEMBERS` of one cluster a row."""

    def pack(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        for batch in batches:
            own = batch.column("cluster").to_numpy()
            for cluster in np.unique(own).tolist():
                at = np.flatnonzero(own == cluster)
                for k in range(0, len(at), MEMBERS):
                    some = pa.Table.from_batches([batch.take(pa.array(at[k : k + MEMBERS]))]).select(fields)
                    sink = pa.BufferOutputStream()
                    with pa.ipc.new_stream(sink, some.schema) as out:
                        out.write_table(some)
                    yield pa.record_batch([pa.array([cluster], pa.int32()), pa.array([sink.getvalue().to_pybytes()], pa.binary())], ["cluster", "members"])

    # Few rows a partition would make blocks small, so anchors of a cluster are dealt together by a salt.
    n = members.count()
    parts = max(1, min(int(members.sparkSession.conf.get("spark.sql.shuffle.partitions")), n // MEMBERS))
    dealt = members.select("cluster", *fields).repartition(parts, F.pmod(F.xxhash64("entry"), F.lit(parts)))
    return dealt.mapInArrow(pack, "cluster int, members binary")


def _scores(a, b):
    """Inner products of the rows of two whole matrices, exact."""
    import numpy as np

    largest = [int(np.abs(x).max(initial=0)) for x in (a, b)]
    if largest[0] * largest[1] * a.shape[1] < 1 << 53:
        return (a.astype(float) @ b.astype(float).T).astype(np.int64)
    return a @ b.T


def _met(members: DataFrame, blocks: DataFrame, lanes: int, pick, schema: str) -> DataFrame:
    """What `pick` finds for every block of members and every block of their cluster's list among `blocks`.

    The list's blocks are dealt over lanes, so a cluster is not one task; members go to every lane."""

    def compare(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            for row in range(batch.num_rows):
                yield pick(*(pa.ipc.open_stream(batch.column(k)[row].as_py()).read_all().combine_chunks() for k in (0, 1)))

    copies = members.withColumn("lane", F.explode(F.sequence(F.lit(0), F.lit(lanes - 1))))
    dealt = blocks.withColumn("lane", F.pmod(F.xxhash64("high", "low"), F.lit(lanes)).cast("int"))
    return copies.join(dealt, ["cluster", "lane"]).select("members", "rows").mapInArrow(compare, schema)


def _ordered(some, rows):
    """The rows' ids, and for each member the rows from its highest score, equal ones by their smallest id: order, score,
    and whether the label is the member's."""
    import numpy as np

    ids = rows["ids"].to_pylist()
    by_id = np.argsort(np.array([i[0] for i in ids], np.int64), kind="stable")
    scores = _scores(_matrix(some["vector"].chunk(0)), _matrix(rows["vector"].chunk(0)))
    order = by_id[np.argsort(-scores[:, by_id], axis=1, kind="stable")]
    same = some["label"].to_numpy()[:, None] == rows["label"].to_numpy()[None, :]
    return ids, order, np.take_along_axis(scores, order, axis=1), np.take_along_axis(same, order, axis=1)


def _first(ids: list, order, scores, on, wanted: int):
    """The ids of each member's first `wanted` rows with `on`: member, column, id and score. Their best `wanted` are among
    these: an entry beyond has as many entries before it, each with an id before all of its own."""
    import numpy as np

    member, place = np.nonzero(on & (np.cumsum(on, axis=1) <= wanted))
    column = order[member, place]
    sizes = np.array([len(i) for i in ids], np.int64)[column]
    found = np.array([i for c in column.tolist() for i in ids[c]], np.int64)
    return np.repeat(member, sizes), np.repeat(column, sizes), found, np.repeat(scores[member, place], sizes)


def _pick_positives(some, rows):
    import pyarrow as pa

    ids, order, scores, same = _ordered(some, rows)
    member, column, found, score = _first(ids, order, scores, same, POSITIVES + 1)
    columns = [some["entry"].to_numpy()[member], rows["entry"].to_numpy()[column], found, score]
    return pa.record_batch([pa.array(c) for c in columns], ["entry", "other", "vec_id", "score"])


def _pick_negatives(some, rows):
    import numpy as np
    import pyarrow as pa

    ids, order, scores, same = _ordered(some, rows)
    made, wanted = [], some["bands"].to_pylist()
    for k in range(max(map(len, wanted))):
        positive = np.array([w[k] if k < len(w) else -1 for w in wanted], np.int64)
        high, low = MOST * positive[:, None], LEAST * positive[:, None]
        on = ~same & (100 * scores <= high) & (100 * scores >= low) & (high >= 0)
        member, column, found, score = _first(ids, order, scores, on, NEGATIVES)
        made.append([some["entry"].to_numpy()[member], positive[member], rows["entry"].to_numpy()[column], found, score])
    columns = [np.concatenate(c) for c in zip(*made, strict=True)]
    return pa.record_batch([pa.array(c) for c in columns], ["entry", "positive_score", "other", "vec_id", "score"])


def _walk(members: DataFrame, fields: list[str], blocks: DataFrame, spans: DataFrame, group: list[str], wanted: int, pick, schema: str, goal) -> DataFrame:
    """The best `wanted` rows of each `group` that `pick` finds, every member walking its list until nothing is left that
    `goal` says may still count: it gives, from what was found, entry and the least score of interest.

    `spans`: cluster, and the bounds of its blocks in order, `highs`."""
    spark = members.sparkSession
    order = Window.partitionBy(*group).orderBy(F.desc("score"), "vec_id", "other")
    found, walking, at, step = spark.createDataFrame([], schema), members, 0, 1
    longest = spans.agg(F.max(F.size("highs"))).first()[0] or 0
    while at < longest and walking.limit(1).count():
        # A step's blocks have bounds from that of the first to above that of the next one after them.
        ends = spans.select("cluster", F.get("highs", F.lit(at)).alias("first"), F.get("highs", F.lit(at + step)).alias("next"))
        here = blocks.join(F.broadcast(ends), "cluster").filter("high <= first and (next is null or high > next)")
        more = _met(_packed_members(walking, fields), here.select("cluster", "high", "low", "rows"), min(LANES, step), pick, schema)
        best = found.unionByName(more).withColumn("place", F.row_number().over(order)).filter(F.col("place") <= wanted).drop("place")
        found = staged(best, "found")
        left = walking.join(goal(walking, found), "entry", "left").join(F.broadcast(ends), "cluster")
        bound = F.col("norm") * F.col("next")
        walking = staged(left.filter(F.col("next").isNotNull() & (bound + F.abs(bound) * 1e-9 + 1e-3 >= F.coalesce("least", F.lit(float("-inf"))))).select(*members.columns), "walking")
        at, step = at + step, step * GROWTH
    return found


def _positive_goal(members: DataFrame, found: DataFrame) -> DataFrame:
    """The last one's score, once there are enough."""
    full = found.groupBy("entry").agg(F.count(F.lit(1)).alias("n"), F.min("score").alias("last"))
    return full.select("entry", F.when(F.col("n") > POSITIVES, F.col("last")).alias("least"))


def _negative_goal(members: DataFrame, found: DataFrame) -> DataFrame:
    """The least of what the bands need: the last one's score, once there are enough, else the band's lower end."""
    full = found.groupBy("entry", "positive_score").agg(F.count(F.lit(1)).alias("n"), F.min("score").alias("last"))
    need = members.select("entry", F.explode("bands").alias("positive_score")).join(full, ["entry", "positive_score"], "left")
    lower = F.col("positive_score") * LEAST / 100
    return need.groupBy("entry").agg(F.min(F.when(F.col("n") >= NEGATIVES, F.col("last")).otherwise(lower)).alias("least"))


def hard_negatives(vectors: DataFrame, anchor: Column, clusters: int = CLUSTERS, block: int = BLOCK) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score; `anchor` says which rows are anchors."""
    spark = vectors.sparkSession
    usable = staged(usable_rows(vectors, anchor), "usable")
    rows = staged(entries(usable), "entries")
    anchors = staged(usable.filter("anchor").select(F.col("vec_id").alias("anchor_id"), "label", "vector").join(rows.drop("ids"), ["label", "vector"]), "anchors")
    # Anchors with one entry differ in nothing but themselves: they walk as one.
    asking = anchors.groupBy("entry").agg(F.any_value("label").alias("label"), F.any_value("vector").alias("vector"))
    middle = centres(asking, clusters)
    if middle is None:
        return spark.createDataFrame([], "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long")
    centre = spark.sparkContext.broadcast(middle)
    members = staged(clustered(asking, centre), "members")
    widths = {r.cluster: r.angle for r in members.groupBy("cluster").agg(F.max("angle").alias("angle")).collect()}
    blocks = staged(lists(rows, centre, [widths.get(k) for k in range(len(middle))], block), "lists")
    spans = staged(blocks.groupBy("cluster").agg(F.sort_array(F.collect_set("high"), asc=False).alias("highs")), "spans")

    schema = "entry long, other long, vec_id long, score long"
    found = _walk(members, ["entry", "label", "vector"], blocks, spans, ["entry"], POSITIVES + 1, _pick_positives, schema, _positive_goal)
    place = F.row_number().over(Window.partitionBy("anchor_id", "entry").orderBy(F.desc("positive_score"), "positive_id", "other"))
    others = found.select("entry", "other", F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score"))
    positives = anchors.select("anchor_id", "entry").join(others, "entry").filter("other != entry or positive_id != anchor_id")
    positives = positives.withColumn("place", place).filter(F.col("place") <= POSITIVES)

    # The same bands hold for all anchors of an entry, whichever of its own ids each of them leaves out.
    bands = found.filter("score >= 0").groupBy("entry").agg(F.array_sort(F.collect_set("score")).alias("bands"))
    asking = staged(members.join(bands, "entry"), "members")
    schema = "entry long, positive_score long, other long, vec_id long, score long"
    group = ["entry", "positive_score"]
    found = _walk(asking, ["entry", "label", "vector", "bands"], blocks, spans, group, NEGATIVES, _pick_negatives, schema, _negative_goal)
    rank = F.row_number().over(Window.partitionBy(*group).orderBy(F.desc("score"), "vec_id", "other"))
    ranked = found.select(*group, rank.alias("rank"), F.col("vec_id").alias("negative_id"), F.col("score").alias("negative_score"))
    return positives.join(ranked, group).select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
