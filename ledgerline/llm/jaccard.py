"""Exact Jaccard join of documents on word n-grams with token-combination prefixes.

Terms: a document's tokens are its distinct word n-grams (as 64-bit hashes); documents with equal token sets form a
class, and only classes are compared. All classes order tokens alike: rare ones first, frequent ones last, by hash in
each. Two sets with Jaccard of at least t share at least o(n) = ceil(t n) tokens, so with e(n) = n - o(n):

* prefixes extended to e + k tokens, k = 1 + e / EXTEND, share at least the smaller k. If one of them is all rare, so
  are the shared tokens, all of them single keys. As that many keys are shared, each class can leave out k - 1 of its
  keys (k for the smallest size that it can be similar to), and leaves out those in which most documents meet: keys
  of boilerplate and of passages that many documents hold;
* else, their first shared token lies in the first e + 1 tokens of both. If it is rare, that single token is a key;
* else all shared tokens are frequent. Both prefixes are extended to e + K tokens, K = e + 2, and hold the first
  min(K) shared ones. At most e(x) + e(y) other tokens lie between these, so for t > 1/2 some two neighbours among
  them have at most two others between, counted in both: the pair of them is a key if each token is combined with the
  three frequent ones after it. That is linear in the size of a document, not quadratic.

Every similar pair of classes hence meets in a key. Most meet many times and in large groups, so pairs are not listed:

* each class is first compared with the LEADERS classes with which it shares most among those that come first or last
  in its keys in several orders, and components are formed;
* only keys whose classes lie in several components can still change the result. A leader that shares STRONG keys with
  a class is a hub of it, and so are its FULLEST keys. The commonest hub among a key's classes is the root of the key,
  and all classes of all keys of a root are one group, so each pair that shares a key meets in a group. A class is sent
  once to each group that it is in, with its tokens, and a group gives back as many links as its components need: what
  is sent grows with the classes and not with their pairs. Groups beyond BLOCK are dealt as pairs of blocks."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import buffers, discard, give_back, grams, mix, row_bounds, save, slices, small_side, text_of, words_in
from .graph import components

#: Tokens are counted in windows of about so many. A token is reported from LOCAL times in a window on; LOCAL times the
#: number of windows make it frequent, so at most WINDOW / LOCAL tokens are frequent, however large the table is.
WINDOW = 1_000_000
LOCAL = 4
#: Prefixes are longer by 1 / EXTEND of e(n), so that as many crowded keys can be left out.
EXTEND = 2
#: Orders of classes by which groups name a first and a last one, and how many of these a class is compared with.
ORDERS = (0, 0x5DEECE66D1234567, 0x2545F4914F6CDD1D)
LEADERS = 4
#: A leader that shares so many keys with a class is one of its hubs.
STRONG = 8
#: So many keys of a class, those that most other classes have, are hubs too.
FULLEST = 2
#: Classes and tokens in a block of a group, about.
BLOCK, BLOCK_TOKENS = 8192, 2_000_000
#: Sets of a group that are compared at a time.
TILE = 512
#: More keys than any document has, and an end behind all tokens.
ALL = 2**30
END = 2**63 - 1


def token_sets(data: np.ndarray, offsets: np.ndarray, words: int) -> Iterator[np.ndarray]:
    """Sorted distinct tokens of each row; a row of fewer words has its whole sequence as its one token."""
    n = len(offsets) - 1
    h, row, _, _ = words_in(data, offsets, lower=True)
    g = grams(h, words)
    same = row[: len(g)] == row[words - 1 :] if len(g) else np.zeros(0, bool)
    at, own = row_bounds(row[: len(g)][same], n), row_bounds(row, n)
    g = g[same].view(np.int64)
    for d in range(n):
        few = own[d + 1] - own[d]
        yield np.unique(g[at[d] : at[d + 1]]) if few >= words or not few else grams(h[own[d] : own[d + 1]], few).view(np.int64)


def class_of(tokens: np.ndarray) -> int:
    return int.from_bytes(hashlib.blake2b(tokens.tobytes(), digest_size=8).digest(), "little", signed=True)


def index_keys(tokens: np.ndarray, frequent: np.ndarray, percent: int) -> tuple[np.ndarray, int, int]:
    """Keys of a token set: rare single tokens (even), and close pairs of frequent ones (odd). How many must be kept:
    if its extended prefix is all rare, any others can be left out. And up to where all its rare tokens are keys."""
    n = len(tokens)
    if n < 2:  # equal to another, which is the same class, or similar to none
        return tokens[:0], 0, END
    least = -(-percent * n // 100)
    spare = n - least
    often = np.zeros(n, bool)
    if len(frequent):
        i = np.searchsorted(frequent, tokens)
        often = frequent[np.minimum(i, len(frequent) - 1)] == tokens
    rare, more = tokens[~often], min(1 + spare // EXTEND, least)
    if len(rare) > spare:
        keys = rare[: spare + more] & ~1
        if len(keys) < spare + more:
            return keys, ALL, END
        fewest = least - -(-percent * least // 100)
        return keys, len(keys) - min(fewest // EXTEND, more - 1), int(keys[-1])
    common = tokens[often][: max(0, min(spare + spare + 2, n) - len(rare))].view(np.uint64)
    pairs = [mix(common[:-k] * np.uint64(3) + mix(common[k:])) for k in (1, 2, 3) if len(common) > k]
    return np.concatenate([rare & ~1, *(np.unique(x).view(np.int64) | 1 for x in pairs)]), ALL, END


def shared(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """How many tokens each pair of sets shares, as a matrix.

    Tokens of many sets are multiplied out as columns of two matrices; the pairs of sets that hold another are counted."""
    m, n = len(left), len(right)
    x, y = np.concatenate(left), np.concatenate(right)
    known, out = np.intersect1d(x, y), np.zeros((m, n), np.float32)
    if not len(known):
        return out

    def coded(tokens: np.ndarray, sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        at = np.minimum(np.searchsorted(known, tokens), len(known) - 1)
        own = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
        ok = known[at] == tokens
        order = np.argsort(at[ok], kind="stable")
        code = at[ok][order]
        return code, own[ok][order], np.bincount(code, minlength=len(known))

    (cx, i, fx), (cy, j, fy) = coded(x, left), coded(y, right)
    many = fx * fy * 32 > m * n
    column = np.cumsum(many) - 1
    for lo in range(0, int(many.sum()), 2048):
        parts = []
        for code, own, size in ((cx, i, m), (cy, j, n)):
            here = many[code] & (column[code] >= lo) & (column[code] < lo + 2048)
            part = np.zeros((size, 2048), np.float32)
            part[own[here], column[code[here]] - lo] = 1
            parts.append(part)
        out += parts[0] @ parts[1].T
    few = ~many[cx]
    cx, i, begin = cx[few], i[few], np.cumsum(fy) - fy
    upto = np.cumsum(fy[cx])
    lo = 0
    while lo < len(cx):
        done = upto[lo - 1] if lo else 0
        hi = max(lo + 1, int(np.searchsorted(upto, done + 2_000_000, "right")))
        times = fy[cx[lo:hi]]
        at = np.repeat(begin[cx[lo:hi]] - (upto[lo:hi] - times - done), times) + np.arange(times.sum())
        out += np.bincount(np.repeat(i[lo:hi], times) * n + j[at], minlength=m * n).reshape(m, n)
        lo = hi
    return out


def joining(sets: list[np.ndarray], label: np.ndarray, side: np.ndarray, percent: int) -> list[tuple[int, int]]:
    """Pairs of sets that link, as many as it takes to join the labels that links join.

    Sets with one label are not compared; if there are two sides, sets are compared only across these."""
    size = np.array([len(s) for s in sets])
    order = np.argsort(size, kind="stable")
    _, label = np.unique(label, return_inverse=True)
    parent, out, across = list(range(int(label.max()) + 1)), [], side.min() != side.max()

    def root(x: int) -> int:
        while parent[x] != x:
            parent[x] = x = parent[parent[x]]
        return x

    for lo in range(0, len(order), TILE):
        a = order[lo : lo + TILE]
        for at in range(lo, len(order), TILE):
            b = order[at : at + TILE]
            if 100 * size[a[-1]] < percent * size[b[0]]:
                break
            x, y = label[a], label[b]
            open_ = x[:, None] != y[None, :]
            if across:
                open_ &= side[a][:, None] != side[b][None, :]
            rows, columns = open_.any(1), open_.any(0)
            if not rows.any():
                continue
            a2, b2, open_ = a[rows], b[columns], open_[rows][:, columns]
            same = shared([sets[k] for k in a2], [sets[k] for k in b2])
            i, j = np.nonzero(open_ & (100 * same >= percent * (size[a2][:, None] + size[b2][None, :] - same)))
            _, first = np.unique(label[a2[i]] * len(parent) + label[b2[j]], return_index=True)
            for p, q in zip(a2[i[first]].tolist(), b2[j[first]].tolist(), strict=True):
                u, v = root(label[p]), root(label[q])
                if u != v:
                    parent[u] = v
                    out.append((p, q))
            if len(first):
                label = np.array([root(k) for k in range(len(parent))])[label]
    return out


def similar(df: DataFrame, words: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of df: id, n_shingles, class_id, component_id (smallest id in the component).

    Rows link when 100 * |intersection| >= percent * |union| of their sets of distinct `words`-word shingles, A-Z
    lower-cased; 50 < percent <= 100. Null, empty and blank texts have no shingles, link with nothing and are their
    own component. Repeated rows and equal sets are one class. Very long texts are handled whole. An empty table gives
    an empty result; extra columns are ignored."""
    if not 50 < percent <= 100:
        raise ValueError("percent must be above 50 and at most 100")
    spark = df.sparkSession
    docs = df.select(F.col(id_col).alias("_id"), text_of(text_col).alias("_text"), F.xxhash64(text_of(text_col)).alias("_print"))
    id_type = docs.schema["_id"].dataType.simpleString()

    def sets_of(batches: Iterator[pa.RecordBatch], column: int) -> Iterator[tuple[pa.RecordBatch, int, int, list[np.ndarray]]]:
        for batch in batches:
            data, offsets = buffers(batch.column(column))
            for i, j in slices(offsets):
                yield batch, i, j, list(token_sets(data, offsets[i : j + 1], words))
        give_back()

    def profile(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows of documents; and for each window of tokens one without a token and one for each that it often has."""
        names, kept, kind = ["_id", "_print", "n", "class", "token", "times"], [], None

        def counted() -> pa.RecordBatch:
            token, times = np.unique(np.concatenate(kept), return_counts=True)
            token, times = token[times >= LOCAL], times[times >= LOCAL]
            kept.clear()
            none = pa.nulls(len(token) + 1, pa.int64())
            return pa.RecordBatch.from_arrays([pa.nulls(len(token) + 1, kind), none, none, none, pa.array([None, *token.tolist()], pa.int64()), pa.array([1, *times.tolist()], pa.int64())], names=names)

        for batch, i, j, sets in sets_of(batches, 1):
            kind = batch.column(0).type
            kept += sets
            ids, none = batch.column(0).slice(i, j - i), pa.nulls(j - i, pa.int64())
            yield pa.RecordBatch.from_arrays([ids, batch.column(2).slice(i, j - i), pa.array([len(s) for s in sets], pa.int64()), pa.array([class_of(s) for s in sets], pa.int64()), none, none], names=names)
            if sum(map(len, kept)) > WINDOW:
                yield counted()
        if kept:
            yield counted()

    profiles = save(docs.select("_id", "_text", "_print").mapInArrow(profile, f"_id {id_type}, _print long, n long, class long, token long, times long"), "profiles")
    rows = profiles.filter("n is not null").select("_id", "_print", "n", "class")
    windows = profiles.filter("n is null and token is null").count()
    often = profiles.filter("n is null and token is not null").groupBy("token").agg(F.sum("times").alias("times")).filter(F.col("times") >= LOCAL * windows)
    frequent = spark.sparkContext.broadcast(np.sort(often.select("token").toArrow().column(0).to_numpy()))

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, _, _, sets in sets_of(batches, 0):
            keys, keep, ends = zip(*(index_keys(s, frequent.value, percent) for s in sets), strict=True)
            times, singles = [len(k) for k in keys], [int((k & 1 == 0).sum()) for k in keys]
            column = [np.repeat(np.array(x, kind), times) for x, kind in (([class_of(s) for s in sets], np.int64), ([len(s) for s in sets], np.int32), (keep, np.int32), (singles, np.int32), (ends, np.int64))]
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in (np.concatenate(keys), *column)], names=["key", "class", "n", "keep", "singles", "end"])

    indexed = docs.select("_text").mapInArrow(index, "key long, class long, n int, keep int, singles int, end long")
    met = indexed.groupBy("key").agg(F.min("class").alias("p"), F.max("class").alias("q"), F.count("*").alias("crowd")).filter("p <> q")
    met = save(met.select("key", "crowd"), "met-keys")
    meeting = save(indexed.join(met, "key").distinct(), "meeting")
    own = Window.partitionBy("class")
    known = F.count_if(F.col("key").bitwiseAND(1) == 0).over(own)  # its single keys that others have as keys too
    place = F.row_number().over(own.orderBy("crowd", "key")) + F.col("singles") - F.col("known")  # keys in which it is alone come before all these
    members = meeting.withColumn("known", known).withColumns({"_place": place, "weight": F.sum("crowd").over(own)}).filter("_place <= keep")
    members = members.select("key", "class", F.struct("n", (F.col("n") - F.col("singles")).alias("behind"), "known", "end").alias("reach"), "weight")
    members = save(members, "members")
    classes = save(rows.filter("n > 0").groupBy("class").agg(F.min("_id").alias("doc"), F.min_by("_print", F.struct(F.col("_id").isNull(), "_id")).alias("print"), F.first("n").alias("n"), F.count("*").alias("copies")), "classes")

    # a single key of the class whose keys end first is a key of the other too if that has the token at all, so the two
    # share at most the lesser number of known keys, and what the first has behind its keys; for the other class this
    # does not hold, as its last keys can be tokens behind the keys of the first
    behind = "case when reach.end < reach2.end then reach.behind when reach.end > reach2.end then reach2.behind else least(reach.behind, reach2.behind) end"
    most = f"least(reach.n, reach2.n, {behind} + least(reach.known, reach2.known))"
    plausible = F.expr(f"100 * {most} >= {percent} * (reach.n + reach2.n - {most})")
    turned = [F.col("class").bitwiseXOR(F.lit(x).cast("long")) for x in ORDERS]
    ends = [f(x).bitwiseXOR(F.lit(y).cast("long")) for x, y in zip(turned, ORDERS, strict=True) for f in (F.min, F.max)]
    central = F.max_by("class", F.struct("weight", "class"))  # of near copies the one with fewest words of its own
    leaders = members.groupBy("key").agg(F.array_distinct(F.array(central, *ends)).alias("leaders")).filter("size(leaders) > 1")
    pairs = members.join(leaders, "key").select("class", "reach", F.explode("leaders").alias("leader")).filter("class <> leader")
    pairs = pairs.groupBy("class", "leader", "reach").agg(F.count("*").alias("times"))
    pairs = pairs.join(members.select(F.col("class").alias("leader"), F.col("reach").alias("reach2")).distinct(), "leader").filter(plausible)
    best = F.row_number().over(Window.partitionBy("class").orderBy(F.desc("times"), "leader"))
    stars = pairs.withColumn("_r", best).filter(F.col("_r") <= LEADERS).select(F.col("leader").alias("a"), F.col("class").alias("b"), "times")
    stars = save(stars, "star-pairs")

    def texts_for(wanted: DataFrame) -> DataFrame:
        """The text of one document of each class of a saved table, with its other columns."""
        wanted = small_side(wanted)
        same = docs["_id"].eqNullSafe(wanted["doc"]) & (docs["_print"] == wanted["print"])
        return docs.join(wanted, same).select("_text", *(c for c in wanted.columns if c not in ("doc", "print")))

    def sets_out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, i, _, sets in sets_of(batches, 0):
            wanted, places, out = batch.column(1), batch.column(2), []
            for d, tokens in enumerate(sets, i):
                if class_of(tokens) == wanted[d].as_py():
                    raw = tokens.tobytes()
                    out += [(p["root"], p["part"], p["role"], wanted[d].as_py(), raw) for p in places[d].as_py()]
                    while len(out) > 500:
                        yield pack(out[:500])
                        del out[:500]
            if out:
                yield pack(out)

    def pack(out: list[tuple]) -> pa.RecordBatch:
        kinds = (pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.binary())
        return pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*out, strict=True), kinds, strict=True)], names=["root", "part", "role", "class", "tokens"])

    def compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, leader, last = None, None, None
        for batch in (b.slice(i, 500) for b in batches for i in range(0, max(1, b.num_rows), 500)):
            out = []
            for root, part, role, b, raw in zip(*(batch.column(k).to_pylist() for k in range(5)), strict=True):
                tokens = np.frombuffer(raw, np.int64)
                if role == 0:
                    at, leader = (root, part), tokens
                elif at == (root, part) and last != (root, part, b):
                    i = np.searchsorted(leader, tokens)
                    same = int((leader[np.minimum(i, len(leader) - 1)] == tokens).sum())
                    if 100 * same >= percent * (len(leader) + len(tokens) - same):
                        out.append((root, b))
                last = (root, part, b) if role else None
            yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in out], pa.int64()) for k in (0, 1)], names=["a", "b"])
        give_back()

    def verified(pairs: DataFrame) -> DataFrame:
        """Those of saved pairs (a, b) of leaders and classes that link. A leader's classes are split into parts of
        about 512; a class goes to the few leaders that it has, a leader to its parts, 64 of them at a time."""
        parts = pairs.groupBy("a").agg(F.ceil(F.count("*") / 512).cast("int").alias("parts"))
        follow = pairs.join(parts, "a").select(F.col("b").alias("class"), F.lit(0).alias("turn"), F.struct(F.col("a").alias("root"), F.pmod(F.xxhash64("b"), F.col("parts")).cast("int").alias("part"), F.lit(1).alias("role")).alias("place"))
        lead = parts.select(F.col("a").alias("class"), F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"))
        lead = lead.select("class", F.expr("part div 64").cast("int").alias("turn"), F.struct(F.col("class").alias("root"), "part", F.lit(0).alias("role")).alias("place"))
        wanted = follow.union(lead).groupBy("class", "turn").agg(F.collect_list("place").alias("places"))
        wanted = save(wanted.join(classes, "class").select("class", "places", "doc", "print"), "wanted")
        sets = texts_for(wanted).mapInArrow(sets_out, "root long, part int, role int, class long, tokens binary")
        dealt = sets.repartition("root", "part").sortWithinPartitions("root", "part", "role", "class")
        return dealt.mapInArrow(compared, "a long, b long")

    def tokens_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, i, j, sets in sets_of(batches, 0):
            names = batch.column(1).slice(i, j - i).to_pylist()
            right = [k for k, (name, tokens) in enumerate(zip(names, sets, strict=True)) if class_of(tokens) == name]
            yield pa.RecordBatch.from_arrays([pa.array([names[k] for k in right], pa.int64()), pa.array([sets[k].tobytes() for k in right], pa.binary())], names=["class", "tokens"])

    def grouped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Links that join components in each group of rows with equal (root, i, j), which come together."""
        held: list[pa.RecordBatch] = []

        def ended() -> pa.RecordBatch:
            got = pa.Table.from_batches(held).combine_chunks()
            held.clear()
            names = got["class"].to_numpy()
            _, once = np.unique(names, return_index=True)
            got, names = got.take(once), names[once]
            sets = [np.frombuffer(x, np.int64) for x in got["tokens"].to_pylist()]
            pairs = np.array(joining(sets, got["component"].to_numpy(), got["side"].to_numpy(), percent), np.int64).reshape(-1, 2)
            return pa.RecordBatch.from_arrays([pa.array(names[pairs[:, 0]]), pa.array(names[pairs[:, 1]])], names=["a", "b"])

        last = None
        for batch in batches:
            if not batch.num_rows:
                continue
            key = np.stack([batch.column(k).to_numpy().astype(np.int64) for k in range(3)], 1)
            starts = np.flatnonzero(np.append(True, (key[1:] != key[:-1]).any(1)))
            for lo, hi in zip(starts.tolist(), [*starts[1:].tolist(), len(key)], strict=True):
                if held and tuple(key[lo]) != last:
                    yield ended()
                last = tuple(key[lo])
                held.append(batch.slice(lo, hi - lo))
        if held:
            yield ended()
        give_back()

    def across(left: DataFrame) -> DataFrame:
        """Links between components among the classes that share one of the saved keys (key, class, component, n)."""
        strong = stars.filter(F.col("times") >= STRONG)
        crowd = left.groupBy("key").agg(F.count("*").alias("crowd"))
        fullest = F.row_number().over(Window.partitionBy("class").orderBy(F.desc("crowd"), "key"))
        fullest = left.join(crowd, "key").withColumn("_r", fullest).filter(F.col("_r") <= FULLEST).select("class", F.xxhash64(F.lit("key"), "key").alias("hub"))
        hubs = strong.select(F.col("b").alias("class"), F.col("a").alias("hub")).union(strong.select("a", "a")).union(fullest).distinct()
        hubs = save(hubs, "hubs")
        best = left.join(hubs, "class").groupBy("key", "hub").agg(F.count("*").alias("times")).groupBy("key").agg(F.max_by("hub", F.struct("times", "hub")).alias("root"))
        member = save(left.join(best, "key").select("root", "class", "component", "n").distinct(), "group-members")
        groups = member.groupBy("root").agg(F.min("component").alias("p"), F.max("component").alias("q"), F.greatest(F.ceil(F.count("*") / BLOCK), F.ceil(F.sum("n") / BLOCK_TOKENS)).cast("int").alias("blocks"))
        member = member.join(groups.filter("p <> q").drop("p", "q"), "root").withColumn("side", F.pmod(F.xxhash64("class"), F.col("blocks")).cast("int"))
        member = member.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        member = save(member.select("root", F.least("side", "other").alias("i"), F.greatest("side", "other").alias("j"), "side", "class", "component"), "placed-members")
        wanted = save(member.select("class").distinct().join(classes, "class").select("class", "doc", "print"), "wanted")
        sets = save(texts_for(wanted).mapInArrow(tokens_of, "class long, tokens binary"), "token-sets")
        dealt = member.join(sets, "class").select("root", "i", "j", "side", "class", "component", "tokens")
        dealt = dealt.repartition("root", "i", "j").sortWithinPartitions("root", "i", "j")
        found = save(dealt.mapInArrow(grouped, "a long, b long"), "links")
        discard(hubs, member, wanted, sets)
        return found

    links = save(verified(stars), "links")
    label = save(components(links), "labels")
    lettered = members.join(label.withColumnRenamed("id", "class"), "class", "left").select("key", "class", F.coalesce("component", "class").alias("component"), "reach.n")
    open_keys = lettered.groupBy("key").agg(F.min("component").alias("p"), F.max("component").alias("q")).filter("p <> q").select("key")
    left = save(lettered.join(open_keys, "key"), "open-members")
    discard(met, meeting, members)
    if not left.isEmpty():
        more = across(left)
        if not more.isEmpty():
            label = save(components(links.union(more)), "labels")
    discard(left, stars)
    named = classes.join(label.withColumnRenamed("id", "class"), "class", "left").withColumn("component", F.coalesce("component", "class"))
    lowest = named.groupBy("component").agg(F.min("doc").alias("low"), F.count("*").alias("size"))
    known = save(named.join(lowest, "component").filter("copies > 1 or size > 1").select("class", "low"), "components")
    result = rows.join(small_side(known), "class", "left").withColumn("component_id", F.when(F.col("n") > 0, F.coalesce("low", "_id")).otherwise(F.col("_id")))
    return result.select(F.col("_id").alias(id_col), F.col("n").alias("n_shingles"), F.col("class").alias("class_id"), "component_id")


def op10_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that share 85 % of their four-word shingles, as components."""
    return similar(spark.read.parquet(f"{sf_dir}/documents.parquet"), words=4, percent=85).select("doc_id", "n_shingles", "component_id")
