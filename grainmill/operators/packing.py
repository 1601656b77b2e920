"""Tokens: vocabulary training, splits, streams packed into fixed blocks, pairs, batches and mixes.

Null and empty arrays of ids take no place in a stream and are split into nothing; documents that tie in an order are
packed one after another in any order; repeated rows are packed as often as they are there; empty tables give no blocks."""

from __future__ import annotations

import heapq
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .grids import first_of
from .selection import running_total
from .shared import small, written
from .vocabulary import BYTES, train_merges

#: Special tokens in the order of their ids, and the pieces that merges may not cross.
SPECIALS = ("<doc>", "<pad>", "<bos>", "<eos>")
PIECES = r"(?U)'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

#: Distinct words whose ids a task keeps, words that it joins at once; documents of a range of the shuffled order.
KEPT, WORDS, RANGE = 200_000, 1 << 18, 5_000


def stripped(text: Column) -> Column:
    """text without white space at its ends."""
    return F.regexp_replace(text, r"(?U)^[\s\x1C-\x1F]+|[\s\x1C-\x1F]+$", "")


def word_counts(docs: DataFrame, text_col: str) -> DataFrame:
    """(word, n): the pieces of stripped texts, with the space before them, counted over all documents."""
    pieces = F.regexp_extract_all(stripped(F.col(text_col)), F.lit(PIECES), 0)
    return docs.select(F.explode(pieces).alias("word")).groupBy("word").agg(F.count("*").alias("n"))


def train_vocabulary(docs: DataFrame, text_col: str, size: int = 32_000, specials: Sequence[str] = SPECIALS) -> tuple[dict[str, int], list[tuple[str, str]]]:
    """(vocabulary, merges): specials, all 256 bytes (each as the character of its number), then merged pieces, learned from
    all words of all documents. Null and empty texts have no words; without pairs left there are fewer merges."""
    merges = [(a.decode("latin-1"), b.decode("latin-1")) for a, b in train_merges(word_counts(docs, text_col), size - 256 - len(specials))]
    vocab = {s: i for i, s in enumerate(specials)}
    for piece in [chr(b) for b in BYTES] + [a + b for a, b in merges]:
        vocab.setdefault(piece, len(vocab))
    return vocab, merges


def bpe_ids(word: str, vocab: dict[str, int], ranks: dict[tuple[str, str], int]) -> list[int]:
    """The ids of a word: the merge of lowest rank, then leftmost, first. Costs n log n, so that a word may be a whole text."""
    p: list[str | None] = [chr(b) for b in word.encode()]
    after, before = list(range(1, len(p) + 1)), list(range(-1, len(p) - 1))
    heap = [(rank, k) for k, pair in enumerate(zip(p, p[1:])) if (rank := ranks.get(pair)) is not None]
    heapq.heapify(heap)
    while heap:
        rank, k = heapq.heappop(heap)
        j = after[k]
        if p[k] is None or j >= len(p) or ranks.get((p[k], p[j])) != rank:
            continue
        p[k], p[j], after[k] = p[k] + p[j], None, after[j]
        if after[k] < len(p):
            before[after[k]] = k
        for left, right in ((before[k], k), (k, after[k])):
            if left >= 0 and right < len(p) and (new := ranks.get((p[left], p[right]))) is not None:
                heapq.heappush(heap, (new, left))
    return [vocab[x] for x in p if x is not None]


def _pieces(texts: pa.Array) -> Iterator[pa.Array]:
    """Texts as lists of words, about WORDS words at a time."""
    upto = np.cumsum(pc.fill_null(pc.list_value_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    cuts = [0, *(np.flatnonzero(np.diff(upto // WORDS)) + 1).tolist(), len(texts)]
    for at, stop in zip(cuts, cuts[1:]):
        yield texts.slice(at, stop - at)


def encode(docs: DataFrame, text_col: str, vocab: dict[str, int], merges: Sequence[tuple[str, str]], start: str = "<doc>", eos: str | None = None) -> DataFrame:
    """Adds ids: the start token, then the ids of the stripped text [, then eos]. The model is sent to tasks once; each
    distinct word of a batch is merged once, and a task keeps up to KEPT words."""
    model = docs.sparkSession.sparkContext.broadcast((vocab, {m: i for i, m in enumerate(merges)}))
    pieces = F.regexp_extract_all(F.concat(F.lit(" "), stripped(F.col(text_col))), F.lit(PIECES), 0)
    ends = int(eos is not None)

    @F.arrow_udf("array<int>")
    def ids(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        vocab, ranks = model.value
        known: dict[str, np.ndarray] = {}
        for texts in (part for batch in batches for part in _pieces(batch)):
            words = texts.flatten().dictionary_encode()
            made = [np.empty(0, np.int32)]  # so that there is one
            for w in words.dictionary.to_pylist():
                if w not in known:
                    if len(known) >= KEPT:
                        known.clear()
                    known[w] = np.array(bpe_ids(w, vocab, ranks), np.int32)
                made.append(known[w])
            sizes, at = np.array([len(m) for m in made]), words.indices.to_numpy() + 1
            n = sizes[at]
            body = np.concatenate(made)[np.repeat((np.cumsum(sizes) - sizes)[at] - (np.cumsum(n) - n), n) + np.arange(n.sum())]
            upto = np.concatenate([[0], np.cumsum(n)])[np.concatenate([[0], np.cumsum(pc.fill_null(pc.list_value_length(texts), 0).to_numpy(zero_copy_only=False))])]
            offsets = upto + np.arange(len(upto)) * (1 + ends)
            out, inner = np.empty(offsets[-1], np.int32), np.ones(offsets[-1], bool)
            out[offsets[:-1]], inner[offsets[:-1]] = vocab[start], False
            if ends:
                out[offsets[1:] - 1], inner[offsets[1:] - 1] = vocab[eos], False
            out[inner] = body
            yield pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(out))

    return docs.withColumn("ids", ids(pieces))


def split_tokens(df: DataFrame, ids: str = "ids", fraction: float = 0.9) -> DataFrame:
    """train_ids and val_ids: none of none, one in train, else a fraction that leaves at least one on each side."""
    n = F.size(ids)
    cut = F.when(n <= 1, n).otherwise(F.least(F.greatest((F.lit(fraction) * n).cast("int"), F.lit(1)), n - 1))
    return df.withColumn("train_ids", F.slice(ids, F.lit(1), cut)).withColumn("val_ids", F.slice(ids, cut + 1, F.greatest(n - cut, F.lit(0))))


def shuffled_positions(df: DataFrame, key: Column, seed: int = 1337, most: int | None = None) -> DataFrame:
    """Adds shuffle_key: a seeded order of documents as a hash, for any number of them; at most the first `most` in it."""
    return first_of(df.withColumn("shuffle_key", F.sha2(F.concat_ws("|", F.lit(str(seed)), key.cast("string")), 256)), most, "shuffle_key")


def seeded_permutation(names: Sequence[str], seed: int = 1337) -> dict[str, int]:
    """The positions that a seeded generator gives a sorted list of names: the compatible shuffle, for lists that fit the
    driver."""
    import random

    order = sorted(names)
    random.Random(seed).shuffle(order)
    return {n: i for i, n in enumerate(order)}


def offsets(df: DataFrame, order: Sequence[str | Column], n: str = "n_tokens") -> DataFrame:
    """Adds before: tokens of all documents ahead, by two-level running sums."""
    return running_total(df, n, order)


def pack(df: DataFrame, length: int, ids: str = "ids", pad: int | None = None) -> DataFrame:
    """(block_id, ids): the stream of all ids in order of `before` cut into blocks of `length`. Each document is exploded
    into the blocks it touches, never into tokens. The remainder is dropped, or padded if it has more than one token."""
    n, at = F.size(ids).cast("bigint"), F.col("before")
    first, last = F.expr(f"before div {length}"), F.expr(f"(before + size({ids}) - 1) div {length}")
    pieces = df.where(F.size(ids) > 0).select("before", ids, F.explode(F.sequence(first, last)).alias("block_id"))
    begin = F.greatest(F.col("block_id") * length - at, F.lit(0))
    stop = F.least((F.col("block_id") + 1) * length - at, n)
    cut = pieces.select("block_id", "before", F.slice(ids, (begin + 1).cast("int"), (stop - begin).cast("int")).alias("part"))
    blocks = cut.groupBy("block_id").agg(F.array_sort(F.collect_list(F.struct("before", "part"))).alias("p")).select("block_id", F.flatten(F.transform("p", lambda x: x["part"])).alias("ids"))
    if pad is None:
        return blocks.where(F.size("ids") == length)
    full = F.concat("ids", F.array_repeat(F.lit(pad), (F.lit(length) - F.size("ids")).cast("int")))
    return blocks.where(F.size("ids") > 1).withColumn("ids", full)


def shifted(blocks: DataFrame, ids: str = "ids") -> DataFrame:
    """x: all but the last id, y: all but the first."""
    n = F.greatest(F.size(ids) - 1, F.lit(0))
    return blocks.withColumn("x", F.slice(ids, F.lit(1), n)).withColumn("y", F.slice(ids, F.lit(2), n))


def collate(df: DataFrame, batch: str, ids: str = "ids", pad: int = 0) -> DataFrame:
    """ids padded to the longest of their batch."""
    longest = F.max(F.size(ids)).over(Window.partitionBy(batch))
    return df.withColumn("__m", longest).withColumn(ids, F.concat(ids, F.array_repeat(F.lit(pad), F.col("__m") - F.size(ids)))).drop("__m")


def split_documents(df: DataFrame, key: Column, ratio: float = 0.05, seed: int = 42) -> DataFrame:
    """Adds split: val for the first max(1, round(n * ratio)) documents (at most n - 1) in a seeded hash order, else train.
    Hashes are counted by their first four digits, then only those of the digits that hold the edge are ordered. Rows that
    share a key are split alike; null keys are one key; a table of one row is all train."""
    keyed = df.withColumn("__k", F.sha2(F.concat_ws("|", F.lit(str(seed)), key.cast("string")), 256))
    counts = sorted(map(tuple, keyed.groupBy(F.substring("__k", 1, 4).alias("d")).count().collect()))  # at most 65,536 rows
    n = sum(c for _, c in counts)
    val = min(max(1, round(n * ratio)), n - 1) if n > 1 else 0
    edge, left = "", val
    for digits, c in counts:
        if 0 < left <= c:
            by_key = keyed.where(F.substring("__k", 1, 4) == digits).groupBy("__k").count().orderBy("__k").limit(left)
            upto = Window.orderBy("__k").rowsBetween(Window.unboundedPreceding, 0)  # a 65,536th of the keys
            edge = by_key.withColumn("upto", F.sum("count").over(upto)).where(F.col("upto") >= left).agg(F.min("__k")).first()[0]
        left -= c
    return keyed.withColumn("split", F.when(F.col("__k") <= F.lit(edge), "val").otherwise("train")).drop("__k")


def pack_groups(df: DataFrame, group: str, order: Sequence[str], length: int, ids: str = "ids") -> DataFrame:
    """(group, block_id, ids): each group of documents packed on its own; each group's remainder is dropped. Places come
    from two-level sums, so a group may hold most of the rows. Null and empty ids take no place; null groups are a group."""
    d = running_total(df.where(F.size(ids) > 0).withColumn("__n", F.size(ids).cast("bigint")), "__n", order, group)
    pieces = d.select(group, "before", ids, F.explode(F.sequence(F.expr(f"before div {length}"), F.expr(f"(before + size({ids}) - 1) div {length}"))).alias("block_id"))
    begin = F.greatest(F.col("block_id") * length - F.col("before"), F.lit(0))
    stop = F.least((F.col("block_id") + 1) * length - F.col("before"), F.size(ids))
    cut = pieces.select(group, "block_id", "before", F.slice(ids, (begin + 1).cast("int"), (stop - begin).cast("int")).alias("part"))
    out = cut.groupBy(group, "block_id").agg(F.array_sort(F.collect_list(F.struct("before", "part"))).alias("p"))
    return out.select(group, "block_id", F.flatten(F.transform("p", lambda x: x["part"])).alias("ids")).where(F.size("ids") == length)


def check_sizes(n_train: int, n_val: int, length: int) -> None:
    """Fails where either stream can't fill one block."""
    for name, n in (("train", n_train), ("val", n_val)):
        if n < length:
            raise ValueError(f"{name} has {n} tokens, fewer than a block of {length}")


def check_specials(vocab: dict[str, int], specials: Sequence[str] = SPECIALS) -> dict[str, int]:
    """The ids of the special tokens; a missing one is an error."""
    if missing := [s for s in specials if s not in vocab]:
        raise ValueError(f"the vocabulary lacks {', '.join(missing)}")
    return {s: vocab[s] for s in specials}


def dataset_bundle(docs: DataFrame, key: str, text_col: str, vocab: dict[str, int], merges: Sequence[tuple[str, str]], length: int = 1024, fraction: float = 0.9, seed: int = 1337, pad: bool = False, most: int | None = None) -> dict[str, DataFrame]:
    """Documents to training and validation blocks: at most the first `most` of the seeded shuffle are encoded once, each
    is split, and both parts are packed in its order. Texts are dealt to ranges of that order, so that ids are written once, with
    their places inside their range, and shuffled once, in pieces of blocks; where ranges start is told by their sums."""
    pad_id = check_specials(vocab)["<pad>"] if pad else None
    chosen = shuffled_positions(docs, F.col(key), seed, most).select("shuffle_key", F.col(text_col).alias("text"))
    ranged = chosen.repartitionByRange(-(-docs.count() // RANGE) or 1, "shuffle_key").sortWithinPartitions("shuffle_key")
    split = split_tokens(encode(ranged, "text", vocab, merges), fraction=fraction).select(F.spark_partition_id().alias("range"), "train_ids", "val_ids")
    placed = written(_placed(split, ("train", "val")))
    upto = Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)  # a row for each range
    sums = placed.groupBy("range").agg(*[F.sum(F.size(f"{part}_ids")).alias(part) for part in ("train", "val")])
    starts = small(written(sums.select("range", *[F.coalesce(F.sum(part).over(upto), F.lit(0)).alias(f"{part}_start") for part in ("train", "val")])), 64)
    out = {}
    for part in ("train", "val"):
        ids = placed.select("range", F.col(f"{part}_ids").alias("ids"), f"{part}_at").join(starts.select("range", f"{part}_start"), "range")
        out[part] = pack(ids.select("ids", (F.col(f"{part}_start") + F.col(f"{part}_at")).alias("before")), length, pad=pad_id)
    return out


def _placed(split: DataFrame, parts: Sequence[str]) -> DataFrame:
    """Adds for each part the ids of rows ahead in the same task; (range, ids of each part)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ahead = dict.fromkeys(parts, 0)
        for b in batches:
            columns = [b.column("range"), *[b.column(f"{part}_ids") for part in parts]]
            for part in parts:
                n = pc.fill_null(pc.list_value_length(b.column(f"{part}_ids")), 0).to_numpy(zero_copy_only=False).astype(np.int64)
                columns.append(pa.array(ahead[part] + np.cumsum(n) - n))
                ahead[part] += int(n.sum())
            yield pa.RecordBatch.from_arrays(columns, names=["range", *[f"{part}_ids" for part in parts], *[f"{part}_at" for part in parts]])

    kinds = ["range int", *[f"{part}_ids array<int>" for part in parts], *[f"{part}_at long" for part in parts]]
    return split.mapInArrow(run, ", ".join(kinds))


def fingerprint(files: DataFrame, *parameters: str) -> str:
    """SHA-256 over the files' own hashes (path, size, time) and the parameters; equal inputs give equal values. Files
    are reduced by a commutative sum, so their order and number don't matter."""
    h = F.conv(F.substring(F.sha2(F.concat_ws("|", "path", "size", "mtime"), 256), 1, 15), 16, 10).cast("decimal(38,0)")
    total, n = files.agg(F.coalesce(F.sum(h), F.lit(0)), F.count("*")).first()
    import hashlib

    return hashlib.sha256("|".join([str(total), str(n), *parameters]).encode()).hexdigest()


def mix_batches(main: DataFrame, extra: DataFrame, order: str, batch: int, ratio: float, steps: int) -> DataFrame:
    """(step, slot, corpus, block_id): round(batch * ratio) blocks of main and the rest of extra at each step, at least one
    of each; each corpus cycles over its blocks, dropping an incomplete last batch."""
    take = min(max(round(batch * ratio), 1), batch - 1)
    plan = main.sparkSession.range(steps).select(F.col("id").alias("step"))
    out = []
    for name, df, k, shift in (("main", main, take, 0), ("extra", extra, batch - take, take)):
        ranked = running_total(df.select(order).withColumn("__one", F.lit(1)), "__one", [order]).select(order, F.col("before").alias("rank"))
        n = ranked.count() // k * k
        if not n:
            raise ValueError(f"{name} has fewer blocks than a batch takes")
        slots = plan.select("step", F.explode(F.sequence(F.lit(0), F.lit(k - 1))).alias("i")).withColumn("rank", (F.col("step") * k + F.col("i")) % n)
        out.append(slots.join(ranked, "rank").select("step", (F.col("i") + shift).alias("slot"), F.lit(name).alias("corpus"), F.col(order).alias("block_id")))
    return out[0].unionByName(out[1])


def replicate(df: DataFrame, times: int, seed: int, key: Column) -> DataFrame:
    """Each row several times, in a seeded order."""
    return df.withColumn("copy", F.explode(F.sequence(F.lit(1), F.lit(times)))).orderBy(F.sha2(F.concat_ws("|", F.lit(str(seed)), key.cast("string"), F.col("copy").cast("string")), 256))


def learning_rate(step: Column, top: float, low: float, warmup: int, decay: int) -> Column:
    """Linear warm-up, then a cosine to `low`."""
    s = step.cast("double")
    if decay <= warmup:
        after = F.lit(low)
    else:
        ratio = F.least(F.greatest((s - warmup) / (decay - warmup), F.lit(0.0)), F.lit(1.0))
        after = F.when(s >= decay, low).otherwise(low + 0.5 * (1 + F.cos(F.pi() * ratio)) * (top - low))
    return F.when(s < warmup, top * s / warmup).otherwise(after) if warmup > 0 else after


def cache_name(names: Sequence[str], suffix: str = "") -> str:
    """A folder name for a set of corpora."""
    return "+".join(sorted(n.strip("/").split("/")[-1] for n in names)) + (f"-{suffix}" if suffix else "")
