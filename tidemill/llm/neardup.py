"""Near-duplicate documents by a chosen-path similarity join.

A document is the set of its word shingles. Sets that are equal form one class,
so exact copies never multiply. Every class gets a signature of minwise values.
Independent random trees branch the classes: a node picks a signature position,
sometimes two, and sends each class to the child named by its value there, so
that similar classes stay together with the probability of their similarity and
a path is taken 1 / threshold times on average.

A node of at most ``limit`` classes ends its branch and is compared
exhaustively. A larger node first compares everything with a few pivots, and
classes that clearly resemble a pivot are proposed as its copies. The branch ends
if all but ``limit`` classes seem copies of one family of pivots, else the whole
node goes on branching. Once the proposals are tested on full sets, all classes
of an ended node that no confirmed link has joined to its largest group meet the
whole node, block by block. So a group of near copies of any size is linked
without listing its pairs, and no estimate takes a class out.

Comparisons use sketches and only propose: a pivot and a class, or a cluster of
classes that hang together by their estimates. Equal clusters of several trees
are one. A link counts once the full shingle sets confirm it; inside a cluster
every two classes that are not yet joined are tested, so nothing is listed pair
by pair and nothing is left out.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemill.llm.common import chain64, hash_words, mix64, text_of, words_of
from tidemill.llm.graph import components
from tidemill.session import materialize, work_path

#: Positions of a signature.
WIDTH = 128
_PROFILE = "doc_id bigint, text_key bigint, n_shingles bigint, class bigint, signature binary"
#: Rounds of branching, after which large nodes are compared as they are.
_ROUNDS = 16


def _seeds(salt: int, n: int) -> np.ndarray:
    return mix64(np.arange(1, n + 1, dtype=np.uint64) + np.uint64(salt << 32))


_FACTORS = _seeds(1, WIDTH) | np.uint64(1)


def shingle_sets(texts: list[str | None], words: int) -> list[np.ndarray]:
    """Sorted distinct 64-bit shingle hashes of each text.

    A text with fewer words than a shingle is one shingle, without words none.
    """
    lists = [words_of(x) for x in texts]
    hashed = hash_words([w for x in lists for w in x])
    rolled = hashed
    for k in range(1, words):
        rolled = chain64(rolled[: len(hashed) - k], hashed[k:]) if len(hashed) > k else rolled[:0]
    sets, at = [], 0
    for own in lists:
        n = len(own)
        if n >= words:
            sets.append(np.unique(rolled[at : at + n - words + 1]))
        elif n:
            whole = hashed[at : at + 1]
            for k in range(1, n):
                whole = chain64(whole, hashed[at + k : at + k + 1])
            # Marked with the length: never equal to a full shingle.
            sets.append(mix64(whole ^ np.uint64(0xA5A5 + n)))
        else:
            sets.append(np.empty(0, np.uint64))
        at += n
    return sets


def signature(shingles: np.ndarray) -> np.ndarray:
    """Minimum of each hash function over a set."""
    least = np.full(WIDTH, np.iinfo(np.uint64).max)
    for i in range(0, len(shingles), 2048):
        least = np.minimum(least, (shingles[i : i + 2048, None] * _FACTORS).min(axis=0))
    return (least >> np.uint64(32)).astype("<u4")


def _grouped(texts: list[str], chars: int) -> Iterator[slice]:
    start = held = 0
    for i, x in enumerate(texts):
        held += len(x)
        if held >= chars:
            yield slice(start, i + 1)
            start, held = i + 1, 0
    if start < len(texts):
        yield slice(start, len(texts))


def _profile(words: int, chars: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column("text").to_pylist()
            for part in _grouped(texts, chars):
                sets = shingle_sets(texts[part], words)
                classes = [
                    int.from_bytes(hashlib.blake2b(s.tobytes(), digest_size=8).digest(), "little", signed=True)
                    if len(s)
                    else None
                    for s in sets
                ]
                own = batch.slice(part.start, part.stop - part.start)
                yield pa.record_batch(
                    [
                        own.column("doc_id"),
                        own.column("text_key"),
                        pa.array([len(s) for s in sets], pa.int64()),
                        pa.array(classes, pa.int64()),
                        pa.array([signature(s).tobytes() if len(s) else None for s in sets], pa.binary()),
                    ],
                    names=["doc_id", "text_key", "n_shingles", "class", "signature"],
                )

    return run


def _matrix(column: pa.Array, kind: str = "<u4") -> np.ndarray:
    """Rows of equally long binaries as a matrix."""
    n = len(column)
    return np.frombuffer(b"".join(column.to_pylist()), kind).reshape(n, -1)


def _children(nodes: np.ndarray, signatures: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Child node and row number; each node picks one position, or two."""
    drawn = mix64(nodes ^ np.uint64(0x5851F42D4C957F2D))
    rows = np.arange(len(nodes))
    first = (drawn % np.uint64(WIDTH)).astype(np.int64)
    other = (first + 1 + ((drawn >> np.uint64(8)) % np.uint64(WIDTH - 1)).astype(np.int64)) % WIDTH
    twice = (drawn >> np.uint64(40)).astype(float) / 2**24 < 1 / threshold - 1
    rows = np.concatenate([rows, rows[twice]])
    position = np.concatenate([first, other[twice]])
    value = signatures[rows, position].astype(np.uint64)
    return chain64(nodes[rows], (position.astype(np.uint64) << np.uint64(32)) | value), rows


def _roots(trees: int, threshold: float):
    roots = _seeds(2, trees)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            signatures = _matrix(batch.column("signature"))
            for root in roots:
                nodes, rows = _children(np.full(batch.num_rows, root), signatures, threshold)
                yield pa.record_batch(
                    [pa.array(nodes.view(np.int64)), batch.column("class").take(pa.array(rows))], names=["node", "class"]
                )

    return run


def _estimate(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Similarity of one-byte sketches, which also agree by chance."""
    # Eight comparisons at a time: the bytes of the sum hold counts up to 16.
    agree = (left == right).view(np.uint64).sum(axis=-1)
    agree = (agree * np.uint64(0x0101010101010101)) >> np.uint64(56)
    return (agree / WIDTH - 1 / 256) / (1 - 1 / 256)


class _Groups:
    """Union of a few ids."""

    def __init__(self):
        self.parent: dict = {}

    def find(self, x):
        parent = self.parent
        while parent.setdefault(x, x) != x:
            parent[x] = x = parent[parent[x]]
        return x

    def join(self, a, b) -> bool:
        a, b = self.find(a), self.find(b)
        self.parent[a] = b
        return a != b


def _against_pivots(clear: float):
    """The links of a class to pivots that it clearly resembles, and the family of the first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        joined, families = _Groups(), {}
        for batch in batches:
            if not batch.num_rows:
                continue
            own = _matrix(batch.column("sketch"), np.uint8)
            family, links = [], []
            nodes, classes = batch.column("node").to_pylist(), batch.column("class").to_pylist()
            for i, pivots in enumerate(batch.column("pivots").to_pylist()):
                names = [p["class"] for p in pivots]
                sketches = np.frombuffer(b"".join(p["sketch"] for p in pivots), np.uint8).reshape(len(names), -1)
                if nodes[i] not in families:
                    # Pivots that clearly resemble each other, named by the first.
                    alike = np.arange(len(names))
                    for k in range(len(names)):
                        _merge(alike, np.flatnonzero(_estimate(sketches[k], sketches) >= clear))
                    families[nodes[i]] = dict(zip(names, alike.tolist()))
                found = _estimate(own[i], sketches)
                near = sorted(((float(e), x) for e, x in zip(found, names) if e >= clear and x != classes[i]), reverse=True)
                family.append(families[nodes[i]][near[0][1]] if near else None)
                # Further pivots count only as far as they join pivots.
                near = near[:1] + [(e, x) for e, x in near[1:] if joined.join((nodes[i], near[0][1]), (nodes[i], x))]
                links.append([x for _, x in near])
            yield pa.record_batch(
                [batch.column("node"), batch.column("class"), pa.array(family, pa.int32()), pa.array(links, pa.list_(pa.int64()))],
                names=["node", "class", "family", "links"],
            )

    return run


def _branch(threshold: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            nodes, rows = _children(
                batch.column("node").to_numpy().view(np.uint64), _matrix(batch.column("signature")), threshold
            )
            yield pa.record_batch(
                [pa.array(nodes.view(np.int64)), batch.column("class").take(pa.array(rows))], names=["node", "class"]
            )

    return run


def _merge(labels: np.ndarray, alike: np.ndarray) -> None:
    """Give all rows of the labels that occur among ``alike`` the smallest of them."""
    found = np.unique(labels[alike])
    if len(found) > 1:
        labels[np.isin(labels, found)] = found[0]


def _split(labels: np.ndarray, ids: np.ndarray) -> Iterator[np.ndarray]:
    """The distinct ids of each label that has two or more."""
    order = np.argsort(labels, kind="stable")
    for own in np.split(order, np.flatnonzero(np.diff(labels[order])) + 1):
        members = np.unique(ids[own])
        if len(members) > 1:
            yield members


def _block(rows) -> tuple[np.ndarray, np.ndarray]:
    ids = np.array([r["class"] for r in rows], np.int64)
    return ids, np.frombuffer(b"".join(r["sketch"] for r in rows), np.uint8).reshape(len(rows), -1)


def _gather(propose: float):
    """Clusters of a whole small node."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for rows in batch.column("block").to_pylist():
                ids, b = _block(rows)
                labels = np.arange(len(ids))
                for i in range(1, len(ids)):
                    hits = np.flatnonzero(_estimate(b[i], b[:i]) >= propose)
                    if len(hits):
                        _merge(labels, np.append(hits, i))
                out += _split(labels, ids)
            yield pa.record_batch([pa.array(out, pa.list_(pa.int64()))], names=["members"])

    return run


def _gather_apart(propose: float):
    """Clusters of differently labelled classes of two blocks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):  # a row holds two whole blocks
                mine, theirs = (batch.column(c).slice(k, 1).to_pylist()[0] for c in ("few", "block"))
                few, a = _block(mine)
                ids, b = _block(theirs)
                of_few, of_ids = (np.array([r["label"] for r in rows], np.int64) for rows in (mine, theirs))
                labels = np.arange(len(few) + len(ids))
                for i in range(len(few)):
                    hits = np.flatnonzero((_estimate(a[i], b) >= propose) & (of_ids != of_few[i]))
                    if len(hits):
                        _merge(labels, np.append(hits + len(few), i))
                out = list(_split(labels, np.concatenate([few, ids])))
                yield pa.record_batch([pa.array(out, pa.list_(pa.int64()))], names=["members"])

    return run


def _sketch():
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                low = _matrix(batch.column("signature")).astype(np.uint8)
                yield pa.record_batch(
                    [batch.column("class"), pa.array([x.tobytes() for x in low], pa.binary())], names=["class", "sketch"]
                )

    return run


def candidates(
    classes: DataFrame,
    threshold: float,
    trees: int,
    limit: int,
    slack: float,
    pivots: int = 8,
) -> tuple[DataFrame, DataFrame, DataFrame | None, DataFrame]:
    """What the trees bring together: pairs (a, b) with pivots, clusters (members) of small
    nodes, large nodes (node, class) for ``apart``, and the sketches of all classes."""
    spark = classes.sparkSession
    kept = lambda df, name: materialize(df, work_path(spark, f"near-{name}"))
    signatures = classes.select("class", "signature")
    sketches = kept(signatures.mapInArrow(_sketch(), "class bigint, sketch binary"), "sketches")
    propose, clear = threshold - slack, threshold + slack / 2
    nodes = signatures.mapInArrow(_roots(trees, threshold), "node bigint, class bigint")
    proposed, wholes, ended = [], [], []
    turns = [F.xxhash64("node", F.lit(i)) for i in range(pivots)]
    for turn in count():
        # A pivot is the smallest class under one of the node's own permutations.
        sizes = nodes.groupBy("node").agg(
            F.count("*").alias("n"), *(F.min(F.col("class").bitwiseXOR(t)).alias(f"least_{i}") for i, t in enumerate(turns))
        )
        chosen = F.array_distinct(F.array(*(F.col(f"least_{i}").bitwiseXOR(t) for i, t in enumerate(turns))))
        sizes = sizes.filter("n > 1").select("node", "n", F.when(F.col("n") > limit, chosen).alias("chosen"))
        placed = kept(nodes.join(sizes, "node"), "nodes")
        wholes.append(placed.filter(F.col("n") <= limit).select("node", "class"))
        large = placed.filter(F.col("n") > limit)
        if large.isEmpty():
            break
        named = large.groupBy("node").agg(F.first("chosen").alias("chosen")).select("node", F.explode("chosen").alias("class"))
        listed = named.join(sketches, "class").groupBy("node").agg(F.collect_list(F.struct("class", "sketch")).alias("pivots"))
        judged = kept(
            large.select("node", "class").join(sketches, "class").join(listed, "node").mapInArrow(
                _against_pivots(clear),
                "node bigint, class bigint, family int, links array<bigint>",
            ),
            "judged",
        )
        links = judged.select("class", F.explode("links").alias("l"))
        proposed.append(
            links.select(F.least("class", "l").alias("a"), F.greatest("class", "l").alias("b"))
        )
        # A branch ends when all but a few classes are of one family.
        shares = judged.groupBy("node", "family").agg(F.count("*").alias("n")).groupBy("node")
        left = shares.agg((F.sum("n") - F.coalesce(F.max(F.when(F.col("family").isNotNull(), F.col("n"))), F.lit(0))).alias("n_left"))
        ends = (F.col("n_left") <= limit) | F.lit(turn + 1 >= _ROUNDS)
        placed = judged.join(left.select("node", ends.alias("ends")), "node")
        ended.append(placed.filter("ends").select("node", "class"))
        # Classes of families go on too: their other links are not compared here.
        going = placed.filter("not ends").select("node", "class")
        nodes = going.join(signatures, "class").mapInArrow(_branch(threshold), "node bigint, class bigint")
    union = lambda frames: reduce(DataFrame.unionByName, frames)
    member = F.collect_list(F.struct("class", "sketch"))
    blocks = union(wholes).join(sketches, "class").groupBy("node").agg(member.alias("block"))
    clusters = blocks.select("block").mapInArrow(_gather(propose), "members array<bigint>").distinct()
    pairs = union([spark.createDataFrame([], "a bigint, b bigint"), *proposed])
    large = kept(union(ended), "large") if ended else None
    return kept(pairs.distinct(), "pairs"), kept(clusters, "clusters"), large, sketches


def apart(large: DataFrame, labels: DataFrame, sketches: DataFrame, propose: float, block_rows: int = 1024) -> DataFrame:
    """Clusters (members) of large nodes (node, class), of classes that are not yet joined.

    Of each node, everything outside its largest label meets the whole node, block by block.
    """
    spark = large.sparkSession
    kept = lambda df, name: materialize(df, work_path(spark, f"near-{name}"))
    named = large.join(labels.toDF("class", "label"), "class", "left").withColumn("label", F.coalesce("label", "class"))
    named = kept(named, "named")
    sizes = named.groupBy("node", "label").agg(F.count("*").alias("n")).groupBy("node")
    sizes = sizes.agg(F.max(F.struct("n", "label")).alias("main"), F.sum("n").alias("n")).filter("n > main.n")
    of_few, of_main = (f"cast(ceil({n} / {block_rows}) as int)" for n in ("(n - main.n)", "main.n"))
    sizes = kept(
        sizes.select("node", F.col("main.label").alias("main"), F.expr(of_few).alias("few"), F.expr(of_main).alias("rest")), "sizes"
    )
    # Blocks of the few come first.
    part = F.expr("if(label <> main, pmod(xxhash64(class), few), few + pmod(xxhash64(class), rest))")
    blocks = kept(
        named.join(sizes, "node")
        .select("node", "class", "label", part.alias("part"))
        .join(sketches, "class")
        .groupBy("node", "part")
        .agg(F.collect_list(F.struct("class", "label", "sketch")).alias("block")),
        "blocks",
    )
    meet = sizes.select("node", "few", "rest", F.explode(F.expr("sequence(0, few - 1)")).alias("own"))
    meet = meet.select("node", "own", F.explode(F.expr("sequence(own, few + rest - 1)")).alias("part"))
    rows = meet.join(blocks.toDF("node", "own", "few"), ["node", "own"]).join(blocks, ["node", "part"]).select("few", "block")
    return kept(rows.mapInArrow(_gather_apart(propose), "members array<bigint>").distinct(), "apart")


def _confirm(words: int, percent: int):
    """Exact test of each row's two texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hub, own = None, np.empty(0, np.uint64)
        for batch in batches:
            a, b, hit = [], [], []
            hubs, members, texts = (batch.column(c).to_pylist() for c in ("hub", "member", "text"))
            for part in _grouped(texts, 1_000_000):
                for h, m, s in zip(hubs[part], members[part], shingle_sets(texts[part], words)):
                    if m is None:
                        hub, own = h, s
                    elif h == hub:
                        shared = len(np.intersect1d(own, s, assume_unique=True))
                        a.append(min(h, m))
                        b.append(max(h, m))
                        hit.append(100 * shared >= percent * (len(own) + len(s) - shared))
            yield pa.record_batch(
                [pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(hit, pa.bool_())], names=["a", "b", "linked"]
            )

    return run


def confirm_pairs(pairs: DataFrame, texts: DataFrame, words: int, percent: int, fan: int = 200) -> DataFrame:
    """Test pairs (a, b) on full shingle sets: a, b, linked.

    Each pair goes to the text of its busier end, dealt by parts of ``fan``
    pairs, so a busy end is repeated rather than gathered.
    """
    busy = pairs.select(F.explode(F.array("a", "b")).alias("class")).groupBy("class").agg(F.count("*").alias("degree"))
    end_a, end_b = busy.toDF("a", "degree_a"), busy.toDF("b", "degree_b")
    stars = (
        pairs.join(end_a, "a")
        .join(end_b, "b")
        .select(
            F.when(F.col("degree_a") >= F.col("degree_b"), F.col("a")).otherwise(F.col("b")).alias("hub"),
            F.when(F.col("degree_a") >= F.col("degree_b"), F.col("b")).otherwise(F.col("a")).alias("member"),
            F.greatest("degree_a", "degree_b").alias("degree"),
        )
        .withColumn("part", F.expr(f"pmod(xxhash64(member), cast(ceil(degree / {fan}) as int))"))
    )
    rows = stars.select("hub", "part", "member", F.col("member").alias("class")).unionByName(
        stars.select("hub", "part", F.lit(None).cast("bigint").alias("member"), F.col("hub").alias("class")).distinct()
    )
    return (
        rows.join(texts, "class")
        .select("hub", "part", "member", "text")
        .repartition("hub", "part")
        .sortWithinPartitions("hub", "part", F.col("member").asc_nulls_first())
        .mapInArrow(_confirm(words, percent), "a bigint, b bigint, linked boolean")
    )


def _shared(sets: list[np.ndarray], columns: int = 2048) -> np.ndarray:
    """Sizes of all intersections, counted over shingles that two sets hold."""
    owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    values, place, held = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    number = np.cumsum(held > 1) - 1
    common = held[place] > 1
    owner, place = owner[common], number[place[common]]
    order = np.argsort(place, kind="stable")
    owner, place = owner[order], place[order]
    sizes = np.zeros((len(sets), len(sets)), np.float32)
    for start in range(0, int(place[-1]) + 1 if len(place) else 0, columns):
        a, b = np.searchsorted(place, [start, start + columns])
        part = np.zeros((len(sets), columns), np.float32)
        part[owner[a:b], place[a:b] - start] = 1
        sizes += part @ part.T
    return sizes


def _confirm_clusters(words: int, percent: int):
    """Links that join the differently labelled classes of each cluster as far as their sets do."""

    def links(names: list[int], labels: list[int], texts: list[str]):
        if len(names) < 2:
            return
        sets = [s for part in _grouped(texts, 1_000_000) for s in shingle_sets(texts[part], words)]
        sizes = np.array([len(s) for s in sets])
        shared = _shared(sets)
        linked = 100 * shared >= percent * (sizes[:, None] + sizes - shared)
        groups = np.unique(labels, return_inverse=True)[1]
        for i in range(1, len(names)):
            apart = np.flatnonzero(linked[i, :i] & (groups[:i] != groups[i]))
            while len(apart):
                _merge(groups, np.array([i, apart[0]]))
                yield names[apart[0]], names[i]
                apart = apart[groups[apart] != groups[i]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cluster, held = None, ([], [], [])
        for batch in batches:
            out = []
            for c, *row in zip(*(batch.column(x).to_pylist() for x in ("cluster", "class", "label", "text"))):
                if c != cluster:
                    out += links(*held)
                    cluster, held = c, ([], [], [])
                for column, value in zip(held, row):
                    column.append(value)
            yield pa.record_batch(
                [pa.array([a for a, _ in out], pa.int64()), pa.array([b for _, b in out], pa.int64())], names=["a", "b"]
            )
        out = list(links(*held))
        yield pa.record_batch(
            [pa.array([a for a, _ in out], pa.int64()), pa.array([b for _, b in out], pa.int64())], names=["a", "b"]
        )

    return run


def confirm_clusters(members: DataFrame, texts: DataFrame, words: int, percent: int) -> DataFrame:
    """Links (a, b) between classes with different labels of clusters (cluster, class, label)."""
    return (
        members.join(texts, "class")
        .select("cluster", "class", "label", "text")
        .repartition("cluster")
        .sortWithinPartitions("cluster", "class")
        .mapInArrow(_confirm_clusters(words, percent), "a bigint, b bigint")
    )


def near_duplicates(
    docs: DataFrame,
    words: int = 5,
    percent: int = 80,
    trees: int = 12,
    limit: int = 2048,
    slack: float = 0.1,
    chunk_chars: int = 1_000_000,
) -> DataFrame:
    """One row per input row: doc_id, n_shingles, component_id, kept, text_key.

    Documents are linked when their shingle sets have 100 x intersection >=
    ``percent`` x union; ``component_id`` is the smallest id of the linked
    group and ``kept`` says that it is the row's own. Null, empty and blank
    texts have no shingles and are linked with nothing. Rows that repeat an id
    and text are one document given twice. A null id is never the smallest
    unless a group has no other. An empty table gives an empty result; other
    columns are ignored.
    """
    spark = docs.sparkSession
    threshold = percent / 100
    keyed = docs.select("doc_id", F.xxhash64(text_of()).alias("text_key"), text_of().alias("text"))
    profiles = materialize(
        keyed.mapInArrow(_profile(words, chunk_chars), _PROFILE), work_path(spark, "near-profiles")
    )
    filled = profiles.filter(F.col("class").isNotNull())
    classes = materialize(
        filled.groupBy("class").agg(
            F.min(F.struct("doc_id", "text_key")).alias("head"), F.min("doc_id").alias("least_id"), F.first("signature").alias("signature")
        ),
        work_path(spark, "near-classes"),
    )
    pairs, clusters, large, sketches = candidates(classes, threshold, trees, limit, slack)
    members = clusters.select(
        F.xxhash64("members").alias("cluster"), F.size("members").alias("n"), F.explode("members").alias("class")
    )
    chosen = members.select("class").unionByName(pairs.select(F.explode(F.array("a", "b")).alias("class")))
    if large is not None:
        chosen = chosen.unionByName(large.select("class"))
    chosen = chosen.distinct()
    heads = classes.join(chosen, "class").select(
        "class", F.col("head.doc_id").alias("head_id"), F.col("head.text_key").alias("head_key")
    )
    same = (F.col("text_key") == F.col("head_key")) & F.col("doc_id").eqNullSafe(F.col("head_id"))
    texts = materialize(
        keyed.join(heads.hint("shuffle_hash"), same).groupBy("class").agg(F.first("text").alias("text")),
        work_path(spark, "near-texts"),
    )
    # First the largest cluster of each class; then only clusters that may still
    # join two components.
    largest = Window.partitionBy("class").orderBy(F.desc("n"), "cluster")
    ranked = materialize(
        members.withColumn("home", F.row_number().over(largest) == 1), work_path(spark, "near-members")
    )
    homes = ranked.filter("home").select("cluster").distinct()
    first = confirm_clusters(
        ranked.join(homes, "cluster").select("cluster", "class", F.col("class").alias("label")), texts, words, percent
    )
    stars = confirm_pairs(pairs, texts, words, percent).filter("linked").select("a", "b")
    links = materialize(first.unionByName(stars), work_path(spark, "near-links"))
    labels = components(links)
    others = ranked.join(homes, "cluster", "left_anti").join(labels.toDF("class", "label"), "class", "left")
    others = others.withColumn("label", F.coalesce("label", "class"))
    mixed = others.groupBy("cluster").agg(F.min("label").alias("low"), F.max("label").alias("high")).filter("low <> high")
    more = confirm_clusters(others.join(mixed.select("cluster"), "cluster"), texts, words, percent)
    more = materialize(more, work_path(spark, "near-more"))
    links = links.unionByName(more)
    if not more.isEmpty():
        labels = components(links)
    if large is not None:
        # Whatever the confirmed links leave apart in a large node is compared.
        split = apart(large, labels, sketches, threshold - slack).select(
            F.xxhash64("members").alias("cluster"), F.explode("members").alias("class")
        )
        split = split.join(labels.toDF("class", "label"), "class", "left").withColumn("label", F.coalesce("label", "class"))
        last = materialize(confirm_clusters(split, texts, words, percent), work_path(spark, "near-last"))
        if not last.isEmpty():
            labels = components(links.unionByName(last))
    grouped = classes.select("class", "least_id").join(labels.toDF("class", "label"), "class", "left")
    grouped = grouped.withColumn("label", F.coalesce("label", "class"))
    smallest = grouped.groupBy("label").agg(F.min("least_id").alias("component_id"))
    of_class = grouped.join(smallest, "label").select("class", "component_id")
    return (
        profiles.select("doc_id", "text_key", "n_shingles", "class")
        .join(of_class, "class", "left")
        .select(
            "doc_id",
            "n_shingles",
            F.when(F.col("class").isNull(), F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"),
            "text_key",
        )
        .withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))
    )
