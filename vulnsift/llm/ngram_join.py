"""N-gram Jaccard join: documents linked when their sets of 5-word shingles have Jaccard similarity 0.8 or more.

1. Documents with equal sets collapse into classes; one document stands for each.
2. Shingles are put in one global order, rare ones first. Two linked sets share a shingle among the first
   s - ceil(0.8 s) + 1 of each (s: set size). A set whose first shingles are its own alone links with nothing.
3. Sets that share such a shingle form candidate groups.
4. Within a group, signature trees: leaves hold sets, nodes the OR of their token bitmaps and the range of their
   sizes; a dual traversal drops node pairs whose greatest possible overlap is too small, and what is left is verified
   on the exact sets. A group of one piece is settled at once, many such groups in one task. Larger groups are cut into
   pieces: each piece is joined with itself, the components found meet through one document each as long as that costs
   less than it saves, and what is still apart is joined piece by piece.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vulnsift.llm.blocks import BLOCK_BYTES, NO_ID, class_of, document_classes, hash_keys, open_block, squeeze, unsqueeze
from vulnsift.llm.common import bounded, distinct, hold, keep_table, release_held, rows_of
from vulnsift.llm.graph import Forest, components, files_for

SHINGLE = 5
#: Similarity as a fraction: 100 * intersection >= 80 * union.
NUMERATOR, DENOMINATOR = 4, 5
#: Sets and tokens joined in one piece, sets in a leaf of a tree, children of a node.
PIECE, TOKENS, LEAF, FANOUT = 512, 1_000_000, 8, 4
#: Shingles for one bucket.
BUCKET_SHINGLES = 2_500_000
#: Pieces whose join takes as long as the jobs of one more round.
ROUND = 64
#: Tokens whose membership is held as a matrix at a time.
COLUMNS = 4096

_M1, _M2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


#: Bytes hashed at a time (a longer word is taken whole).
STRETCH = 1 << 17
_SPACE_AT = re.compile(rb"[\x09-\x0d\x20]")
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_BYTE = np.random.default_rng(77).integers(0, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BYTE[65:91] = _BYTE[97:123]  # A-Z count as a-z
_BASE = np.uint64(0xD6E8FEB86659FD93)
_BACK = np.uint64(pow(0xD6E8FEB86659FD93, -1, 1 << 64))


@lru_cache(maxsize=2)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2^64."""
    return tuple(np.concatenate([np.ones(1, np.uint64), np.cumprod(np.full(n, x, dtype=np.uint64))]) for x in (_BASE, _BACK))


def word_hashes(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hash and start of every word `[^\\x20\\x09-\\x0D]+` of the bytes: a polynomial over all bytes of a stretch,
    from whose running sums each word's own part is taken."""
    buf, hashes, places, a = np.frombuffer(data, dtype=np.uint8), [], [], 0
    while a < len(data):
        b = min(len(data), a + STRETCH)
        if b < len(data):
            cut = _SPACE_AT.search(data, b)
            b = cut.start() if cut else len(data)
        x = buf[a:b]
        space = np.ones(b - a + 2, dtype=bool)
        np.take(_SPACE, x, out=space[1:-1], mode="clip")
        edge = np.flatnonzero(space[1:] != space[:-1])
        start, end = edge[0::2], edge[1::2]
        up, down = _powers(1 << max(17, (b - a).bit_length()))
        part, total = np.take(_BYTE, x, mode="clip"), np.zeros(b - a + 1, dtype=np.uint64)
        part *= up[:b - a]
        np.cumsum(part, out=total[1:])
        h = (total[end] - total[start]) * down[start]
        h = (h ^ (h >> np.uint64(32))) * _M2
        hashes.append(h ^ (h >> np.uint64(29)))
        places.append(start + a)
        a = b
    return np.concatenate([np.zeros(0, np.uint64), *hashes]), np.concatenate([np.zeros(0, np.int64), *places])


def shingle_sets(texts: list[bytes]) -> list[np.ndarray]:
    """For each UTF-8 text the sorted distinct 64-bit hashes of its 5-word shingles. Fewer words: the whole sequence as
    one; none: empty."""
    out = []
    for group in _groups(texts):
        words, places = word_hashes(b" ".join(group))
        starts = np.concatenate([[0], np.cumsum([len(t) + 1 for t in group])])
        first = np.searchsorted(places, starts)
        five = _mixed(words, SHINGLE)
        for a, b in zip(first[:-1].tolist(), first[1:].tolist()):
            out.append(distinct(five[a:b - SHINGLE + 1] if b - a >= SHINGLE else _mixed(words[a:b], b - a)))
    return out


def _groups(texts: list[bytes]) -> Iterator[list[bytes]]:
    """Texts in runs of about a stretch."""
    group, size = [], 0
    for t in texts:
        if group and size + len(t) > STRETCH:
            yield group
            group, size = [], 0
        group.append(t)
        size += len(t)
    if group:
        yield group


def _mixed(words: np.ndarray, size: int) -> np.ndarray:
    """Hash of every run of `size` words."""
    n = len(words) - size + 1
    if n <= 0 or size == 0:
        return np.zeros(0, dtype=np.uint64)
    h = np.full(n, size, dtype=np.uint64)
    for k in range(size):
        h = (h ^ (h >> np.uint64(29))) * _M1 + words[k:n + k]
    h = (h ^ (h >> np.uint64(32))) * _M2
    return h ^ (h >> np.uint64(29))


def sets_of(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Shingle hashes of all texts, distinct in each, and each set's size."""
    sets = shingle_sets(texts)
    return np.concatenate([np.zeros(0, np.uint64), *sets]), np.array([len(s) for s in sets], dtype=np.int64)


BLOCK = "block long, ids binary, sizes binary, body binary, doc_ids array<long>, shingles array<long>, digests array<binary>, text_keys array<long>"
_BLOCK = pa.schema([("block", pa.int64()), ("ids", pa.binary()), ("sizes", pa.binary()), ("body", pa.binary()), ("doc_ids", pa.list_(pa.int64())),
                    ("shingles", pa.list_(pa.int64())), ("digests", pa.list_(pa.binary())), ("text_keys", pa.list_(pa.int64()))])


def digested(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """All rows as a kept table of blocks, with each row's id, number of shingles, digest of its set and hash of its text."""
    rows = docs.select(docs[id_col].cast("long").alias("doc_id"), F.coalesce(docs[text_col], F.lit("")).cast("binary").alias("text"),
                       F.xxhash64(docs[text_col]).alias("text_key"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, ids, texts, keys, size = TaskContext.get().partitionId() << 32, [], [], [], 0

        def block():
            sets = shingle_sets(texts)
            digests = [hashlib.blake2b(s.tobytes(), digest_size=16).digest() for s in sets]
            named = np.array([NO_ID if i is None else i for i in ids], dtype="<i8")
            sizes = np.array([len(t) for t in texts], dtype="<i8")
            return rows_of(_BLOCK, [[number], [named.tobytes()], [sizes.tobytes()], [squeeze(b"".join(texts), 3)], [ids], [[len(s) for s in sets]],
                                    [digests], [keys]])

        for part in (p for batch in batches for p in bounded(batch, 1)):
            for doc, text, key in zip(*(c.to_pylist() for c in part.columns)):
                if texts and size + len(text) > BLOCK_BYTES:
                    yield block()
                    number, ids, texts, keys, size = number + 1, [], [], [], 0
                ids.append(doc)
                texts.append(text)
                keys.append(key)
                size += len(text)
        if texts:
            yield block()

    return keep_table(rows.mapInArrow(run, BLOCK), "blocks")


def classes(blocks: DataFrame) -> tuple[DataFrame, DataFrame]:
    """doc_id, n_shingles, digest, text_key, block, pos of every row; digest, doc_id, weight (number of rows), block and pos of one
    row for each nonempty set, that with the smallest id."""
    row = F.posexplode(F.arrays_zip("doc_ids", "shingles", "digests", "text_keys")).alias("pos", "r")
    members = blocks.select("block", row).select(F.col("r.doc_ids").alias("doc_id"), F.col("r.shingles").alias("n_shingles"), F.col("r.digests").alias("digest"),
                                                 F.col("r.text_keys").alias("text_key"), "block", "pos")
    members = hold(members)
    firsts = members.where("n_shingles > 0 and doc_id is not null").groupBy("digest") \
        .agg(F.min(F.struct("doc_id", "block", "pos")).alias("f"), F.count("*").alias("weight"))
    return members, firsts.select("digest", "f.doc_id", "weight", "f.block", "f.pos")


def first_shingles(size: int) -> int:
    """Length of the part in which two linked sets must meet: s - ceil(0.8 s) + 1."""
    return size - -(-NUMERATOR * size // DENOMINATOR) + 1


NEAR = "doc_id long, size long, tokens array<long>, members binary"
_NEAR = pa.schema([("doc_id", pa.int64()), ("size", pa.int64()), ("tokens", pa.list_(pa.int64())), ("members", pa.binary())])


def near_sets(blocks: DataFrame, firsts: DataFrame) -> DataFrame:
    """The sets that have a shared shingle among their first ones: those shingles, and the whole set."""
    total = blocks.select(F.explode("shingles").alias("n")).agg(F.sum("n")).first()[0] or 0
    bits = max(5, (max(1, total // BUCKET_SHINGLES) - 1).bit_length())
    chosen = firsts.groupBy("block").agg(F.sort_array(F.collect_list("pos")).alias("chosen"))
    # dealt by block once: both the hashes that leave a block and the answers that come back find it there
    marked = blocks.select("block", "ids", "sizes", "body").join(chosen, "block")
    answered = marked.join(document_classes(marked, sets_of, bits), "block", "left")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for ids, sizes, body, chosen, found in zip(*(c.to_pylist() for c in batch.columns)):
                doc_ids, texts = open_block(ids, sizes, body)
                flat, lengths = sets_of([texts[i] for i in chosen])
                rank = class_of(hash_keys(flat, bits), found)
                starts = np.cumsum(lengths) - lengths
                alone = np.add.reduceat(rank == 0, starts, dtype=np.int64)
                first, out = first_shingles(lengths), []
                for k in np.flatnonzero(alone < first).tolist():
                    n, at = int(lengths[k]), int(starts[k])
                    own, r = flat[at:at + n], rank[at:at + n]
                    order = np.lexsort((own, r))[alone[k]:first[k]]
                    out.append((int(doc_ids[chosen[k]]), n, own[order].view(np.int64), squeeze(own.tobytes())))
                if out:
                    yield rows_of(_NEAR, list(zip(*out)))

    # a table, so that the texts and hashes shuffled for it are freed before the sets are joined
    return keep_table(answered.select("ids", "sizes", "body", "chosen", "classes").mapInArrow(run, NEAR), "near")


class Node:
    """Sets low..high of the size order: OR of their bitmaps, range of sizes, and the most tokens that share a bit."""

    __slots__ = ("low", "high", "bits", "least", "most", "excess", "children")

    def __init__(self, low, high, bits, least, most, excess, children):
        self.low, self.high, self.bits, self.least, self.most = low, high, bits, least, most
        self.excess, self.children = excess, children


def tree(sizes: np.ndarray, maps: np.ndarray, excess: np.ndarray) -> Node:
    """Signature tree over sets in ascending size."""
    level = [Node(a, min(a + LEAF, len(sizes)), np.bitwise_or.reduce(maps[a:a + LEAF]), int(sizes[a]),
                  int(sizes[min(a + LEAF, len(sizes)) - 1]), int(excess[a:a + LEAF].max()), []) for a in range(0, len(sizes), LEAF)]
    while len(level) > 1:
        level = [Node(c[0].low, c[-1].high, np.bitwise_or.reduce([x.bits for x in c]), c[0].least, c[-1].most,
                      max(x.excess for x in c), c) for c in (level[i:i + FANOUT] for i in range(0, len(level), FANOUT))]
    return level[0]


def enough(shared: int, a: int, b: int) -> bool:
    """Whether sets of sizes a and b that share that many are linked."""
    return DENOMINATOR * shared >= NUMERATOR * (a + b - shared)


def overlaps(sets: list[np.ndarray]) -> np.ndarray:
    """How many tokens each two sets share: products of membership columns, of tokens in two sets and more."""
    flat, row = np.concatenate(sets), np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    _, token, n = np.unique(flat, return_inverse=True, return_counts=True)
    number = np.cumsum(n > 1) - 1
    row, column = row[n[token] > 1], number[token[n[token] > 1]]
    order = np.argsort(column, kind="stable")
    row, column = row[order], column[order]
    out = np.zeros((len(sets), len(sets)), dtype=np.int64)
    for a in range(0, int(number[-1]) + 1, COLUMNS):
        lo, hi = np.searchsorted(column, [a, a + COLUMNS])
        part = np.zeros((len(sets), min(COLUMNS, int(number[-1]) + 1 - a)), dtype=np.float32)
        part[row[lo:hi], column[lo:hi] - a] = 1
        out += (part @ part.T).astype(np.int64)
    return out


def link_all(sets: list[np.ndarray], same: list[int], sides: list[int] | None = None, every: bool = False) -> list[tuple[int, int]]:
    """Pairs that join all sets which links connect: a dual traversal of the signature tree with itself. Sets with equal
    `same` are taken as joined already, pairs within side 1 as tested already. `every`: all links instead, whatever `same`,
    but for pairs on one of two `sides`."""
    order = sorted(range(len(sets)), key=lambda i: (len(sets[i]), i))
    sizes = np.array([len(sets[i]) for i in order])
    open_ = np.zeros((len(order), len(order)), dtype=bool)
    if len(order) <= LEAF:
        open_[:] = True
    else:
        width = max(64, 1 << int(4 * sizes[-1] - 1).bit_length())
        maps, excess = np.zeros((len(order), width // 8), dtype=np.uint8), np.zeros(len(order), dtype=np.int64)
        for k, i in enumerate(order):
            row = np.zeros(width, dtype=bool)
            row[sets[i] & np.uint64(width - 1)] = True
            maps[k] = np.packbits(row)
            excess[k] = len(sets[i]) - row.sum()
        top = tree(sizes, maps.view(np.uint64), excess)
        work = [(top, top)]
        while work:
            a, b = work.pop()
            # sizes too far apart, or even all common bits and all tokens that share a bit do not reach the overlap
            if NUMERATOR * b.least > DENOMINATOR * a.most or NUMERATOR * a.least > DENOMINATOR * b.most:
                continue
            if a is not b:
                most = int(np.bitwise_count(a.bits & b.bits).sum()) + min(a.excess, b.excess)
                if not enough(min(most, a.most, b.most), a.least, b.least):
                    continue
            if a.children or b.children:
                left, right = a.children or [a], b.children or [b]
                work += [(x, y) for i, x in enumerate(left) for y in (right[i:] if a is b else right)]
                continue
            open_[a.low:a.high, b.low:b.high] = open_[b.low:b.high, a.low:a.high] = True
    open_ &= DENOMINATOR * sizes >= NUMERATOR * sizes[:, None]
    open_ &= open_.T
    np.fill_diagonal(open_, False)
    if sides:
        side = np.array([sides[i] for i in order])
        open_ &= side[:, None] != side if every else (side[:, None] == 0) | (side == 0)
    _, own = np.unique([same[i] for i in order], return_inverse=True)
    if not every:
        open_ &= own[:, None] != own
    if open_.any():
        shared = overlaps([sets[i] for i in order])
        open_ &= DENOMINATOR * shared >= NUMERATOR * (sizes[:, None] + sizes - shared)
    if every:
        return [(order[i], order[j]) for i, j in zip(*(x.tolist() for x in np.nonzero(np.triu(open_))))]
    # what is joined already counts as one: linked sets are reached from the first one not reached yet
    left, out = np.ones(len(order), dtype=bool), []
    members = np.argsort(own, kind="stable")
    ends = np.searchsorted(own[members], np.arange(own.max(initial=-1) + 2))
    for start in range(len(order)):
        if not left[start]:
            continue
        now = members[ends[own[start]]:ends[own[start] + 1]]
        while len(now):
            left[now] = False
            found = np.flatnonzero(open_[now].any(axis=0) & left)
            found = found[np.unique(own[found], return_index=True)[1]]
            out += [(order[start], order[k]) for k in found.tolist()]
            now = np.concatenate([found[:0], *(members[ends[c]:ends[c + 1]] for c in own[found].tolist())])
    return out


def _links(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Links (a, b) between components found within each key; rows: keys, doc_id, comp, big, members."""
    arrow = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def run(table: pa.Table) -> pa.Table:
        sets = [np.frombuffer(unsqueeze(m), dtype=np.uint64) for m in table["members"].to_pylist()]
        comp = table["comp"].to_pylist()
        found = link_all(sets, comp, table["big"].to_pylist())
        return pa.table({"a": pa.array([comp[i] for i, _ in found], pa.int64()), "b": pa.array([comp[j] for _, j in found], pa.int64())}, schema=arrow)

    return rows.select(*keys, "doc_id", "comp", "big", "members").groupBy(*keys).applyInArrow(run, "a long, b long")


def _merged(rows: DataFrame) -> DataFrame:
    """comp, root: what each component joins, where that is another one, by links within each lot, piece and team; rows: lot,
    piece, team, comp, members. No component is in two lots or pieces."""
    arrow = pa.schema([("comp", pa.int64()), ("root", pa.int64())])

    def run(table: pa.Table) -> pa.Table:
        team, comp, members = (table[c].to_numpy() if c != "members" else table[c] for c in ("team", "comp", "members"))
        order = np.argsort(team, kind="stable")
        cuts = np.flatnonzero(np.r_[True, team[order][1:] != team[order][:-1], True])
        out = {}
        for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
            rows_ = order[a:b].tolist()
            own = [int(comp[i]) for i in rows_]
            number = {c: k for k, c in enumerate(sorted(set(own)))}
            if len(number) == 1:
                continue
            forest = Forest(len(number))
            for i, j in link_all([np.frombuffer(unsqueeze(members[r].as_py()), dtype=np.uint64) for r in rows_], own):
                forest.join(number[own[i]], number[own[j]])
            names = list(number)
            out |= {c: names[forest.root(k)] for c, k in number.items() if forest.root(k) != k}
        return pa.table({"comp": pa.array(list(out), pa.int64()), "root": pa.array(list(out.values()), pa.int64())}, schema=arrow)

    return rows.select("lot", "piece", "team", "comp", "members").groupBy("lot", "piece").applyInArrow(run, "comp long, root long")


def _pieces(count: Column, tokens: Column) -> Column:
    return F.greatest(F.ceil(count / PIECE), F.ceil(tokens / TOKENS)).cast("int")


def _sized(teams: DataFrame, near: DataFrame) -> DataFrame:
    """doc_id, team and size (tokens of all sets of the id), kept."""
    sizes = near.groupBy("doc_id").agg(F.sum("size").alias("size"))
    return keep_table(teams.join(sizes, "doc_id").select("doc_id", "team", "size").coalesce(files_for(teams.count())), "teams")


def candidate_groups(near: DataFrame) -> DataFrame:
    """doc_id, team: sets that share a first shingle, closed transitively."""
    posts = near.select("doc_id", F.explode("tokens").alias("token"))
    hubs = posts.groupBy("token").agg(F.min("doc_id").alias("hub"), F.max("doc_id").alias("last")).where("hub < last")
    edges = posts.join(hubs, "token").where("doc_id <> hub").select(F.col("doc_id").alias("a"), F.col("hub").alias("b"))
    return components(edges).withColumnsRenamed({"node": "doc_id", "root": "team"})


def linked(near: DataFrame) -> DataFrame:
    """doc_id, comp: the component of every near set."""
    teams = _sized(candidate_groups(near), near)
    count = teams.count()
    per_team = teams.groupBy("team").agg(_pieces(F.count("*"), F.sum("size")).alias("pieces"), F.sum("size").alias("tokens"))
    state = teams.join(per_team, "team").select("doc_id", "team", F.col("doc_id").alias("comp"), "size", "pieces")
    sets = near.select("doc_id", "members")

    def renamed(found: DataFrame) -> DataFrame:
        """The state with each comp replaced by its root, where it has one."""
        named = state.join(found, "comp", "left")
        return keep_table(named.select("doc_id", "team", F.coalesce("root", "comp").alias("comp"), "size", "pieces").coalesce(files_for(count)), "teams")

    # the first round settles all teams of one piece, about a piece's tokens of them in a task
    most = max(2 * near.sparkSession.sparkContext.defaultParallelism, -(-(per_team.where("pieces = 1").agg(F.sum("tokens")).first()[0] or 0) // TOKENS))
    one = F.col("pieces") == 1
    rows = state.withColumn("lot", F.when(one, F.pmod(F.xxhash64("team"), F.lit(most))).otherwise(F.col("team"))) \
        .withColumn("piece", F.when(one, F.lit(-1)).otherwise(F.pmod(F.xxhash64("doc_id"), F.col("pieces"))).cast("int"))
    state = renamed(_merged(rows.join(sets, "doc_id")))

    # then one document of each component of the others, in pieces, until a round costs more than it spares the last step
    apart = state.where("pieces > 1").count()
    while True:
        tops = state.where("pieces > 1 and comp = doc_id")
        many = tops.groupBy("team").agg(F.count("*").alias("n"), F.sum("size").alias("tokens"), F.max("pieces").cast("long").alias("all")).where("n > 1") \
            .select("team", "n", _pieces(F.col("n"), F.col("tokens")).alias("now"), "all")
        total, now, pairs = many.agg(F.sum("n"), F.sum("now"), F.sum(F.col("now") * F.col("all"))).first()
        if not total or (apart - total) / apart * pairs < now + ROUND:
            break
        apart = total
        rows = tops.join(many.select("team", "now"), "team").withColumn("piece", F.pmod(F.xxhash64("doc_id", F.lit(total)), F.col("now")))
        state = renamed(_merged(rows.join(sets, "doc_id").withColumn("lot", F.col("team"))))

    if total:
        # what is still apart: all members of teams with several components; those of a team's largest component need
        # no test among themselves
        sizes = state.where("pieces > 1").groupBy("team", "comp").agg(F.count("*").alias("n"), F.sum("size").alias("tokens"))
        teams = sizes.groupBy("team").agg(F.max(F.struct("n", F.col("comp").alias("c"), "tokens")).alias("most"), F.sum("n").alias("all"), F.sum("tokens").alias("tokens")) \
            .where("all > most.n").select("team", F.col("most.c").alias("main"), _pieces(F.col("most.n"), F.col("most.tokens")).alias("mains"),
                                          _pieces(F.col("all") - F.col("most.n"), F.col("tokens") - F.col("most.tokens")).alias("others"))
        rows = state.join(teams, "team").withColumn("big", (F.col("comp") == F.col("main")).cast("int"))
        own = F.pmod(F.xxhash64("doc_id"), F.when(F.col("big") == 1, F.col("mains")).otherwise(F.col("others"))).cast("int")
        rows = rows.withColumn("own", own)
        # keys (kind 0: piece of others, piece of the main component; kind 1: two pieces of others)
        every = F.sequence(F.lit(0), F.col("others") - 1)
        across = F.when(F.col("big") == 1, F.transform(every, lambda t: F.struct(F.lit(0).alias("kind"), t.alias("s"), F.col("own").alias("t")))) \
            .otherwise(F.concat(
                F.transform(F.sequence(F.lit(0), F.col("mains") - 1), lambda u: F.struct(F.lit(0).alias("kind"), F.col("own").alias("s"), u.alias("t"))),
                F.transform(every, lambda t: F.struct(F.lit(1).alias("kind"), F.least(t, F.col("own")).alias("s"), F.greatest(t, F.col("own")).alias("t")))))
        rows = rows.withColumn("key", F.explode(across)).select("team", "key.*", "doc_id", "comp", "big")
        found = components(_links(rows.join(sets, "doc_id"), ["team", "kind", "s", "t"]))
        state = renamed(found.withColumnRenamed("node", "comp"))
    return state.select("doc_id", "comp")


def _paired(near: DataFrame, weights: DataFrame) -> DataFrame:
    """team, s, t, side, doc_id, weight, members: each near set once for each piece of its group, with which it meets in (s, t)."""
    teams = _sized(candidate_groups(near), near)
    many = teams.groupBy("team").agg(_pieces(F.count("*"), F.sum("size")).alias("n"))
    rows = teams.join(many, "team").withColumn("own", F.pmod(F.xxhash64("doc_id"), F.col("n")).cast("int"))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("n") - 1))) \
        .select("team", F.least("own", "other").alias("s"), F.greatest("own", "other").alias("t"), "own", "doc_id")
    rows = rows.withColumn("side", (F.col("own") == F.col("t")).cast("int")).drop("own")
    return rows.join(weights, "doc_id").join(near.select("doc_id", "members"), "doc_id")


def _each_link(table: pa.Table) -> list[tuple[int, int]]:
    sets = [np.frombuffer(unsqueeze(m), dtype=np.uint64) for m in table["members"].to_pylist()]
    across = table["s"][0].as_py() != table["t"][0].as_py()
    return link_all(sets, list(range(len(sets))), table["side"].to_pylist() if across else None, every=True)


def _classes_and_near(docs: DataFrame, id_col: str, text_col: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The rows; digest, doc_id and weight (number of rows) of each class; the near sets."""
    blocks = digested(docs, id_col, text_col)
    members, firsts = classes(blocks)  # the members are held: some 50 bytes a row
    return members, firsts, near_sets(blocks, firsts)


def jaccard_links(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """a, b: every pair (a < b) of different shingle sets that link, each set named by the smallest doc_id that has it. Ids are
    taken to be unique; rows without id or shingles take no part."""
    _, firsts, near = _classes_and_near(docs, id_col, text_col)

    def run(table: pa.Table) -> pa.Table:
        ids = table["doc_id"].to_pylist()
        found = [sorted((ids[i], ids[j])) for i, j in _each_link(table)]
        return pa.table({"a": pa.array([x for x, _ in found], pa.int64()), "b": pa.array([y for _, y in found], pa.int64())})

    return _paired(near, firsts.select("doc_id", "weight")).groupBy("team", "s", "t").applyInArrow(run, "a long, b long")


def jaccard_link_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_links of every row: the number of other rows it links with, copies and rows of linked sets. 0 without
    shingles, null without id. Ids are taken to be unique. Pairs are tested once for all copies and never written out."""
    members, firsts, near = _classes_and_near(docs, id_col, text_col)

    def run(table: pa.Table) -> pa.Table:
        weight, total = table["weight"].to_pylist(), [0] * table.num_rows
        for i, j in _each_link(table):
            total[i] += weight[j]
            total[j] += weight[i]
        return pa.table({"doc_id": table["doc_id"], "n": pa.array(total, pa.int64())})

    found = _paired(near, firsts.select("doc_id", "weight")).groupBy("team", "s", "t").applyInArrow(run, "doc_id long, n long") \
        .groupBy("doc_id").agg(F.sum("n").alias("n"))
    counts = firsts.join(found, "doc_id", "left").select("digest", (F.col("weight") - 1 + F.coalesce("n", F.lit(0))).alias("n_links"))
    own = F.when(F.col("doc_id").isNotNull(), F.coalesce("n_links", F.lit(0))).cast("long")
    return members.join(counts, "digest", "left").select("doc_id", own.alias("n_links"))


def jaccard_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id of every row: the smallest doc_id reachable by links, itself included; and text_key, a
    64-bit hash of its text, which tells rows of one id apart.

    Null, empty and blank texts have no shingles and link with nothing. Rows with equal ids are nodes of their own; a row
    without id takes no part in links and its component is null. An empty table gives no rows. Other columns are not read.
    """
    release_held(docs.sparkSession)
    members, firsts, near = _classes_and_near(docs, id_col, text_col)
    comps = linked(near).withColumnRenamed("comp", "root")
    # classes are one row each, so the join splits where many documents have one
    firsts = firsts.join(comps, "doc_id", "left").select("digest", F.coalesce("root", "doc_id").alias("component_id"))
    out = members.join(firsts, "digest", "left")
    own = F.when(F.col("doc_id").isNull(), F.lit(None).cast("long")).otherwise(F.coalesce("component_id", "doc_id"))
    return out.select("doc_id", "n_shingles", own.alias("component_id"), "text_key")
