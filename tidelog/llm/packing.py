"""Texts of varying length into containers of fixed capacity, with little room left.

Method: vector best-fit. A container has three capacities: tokens, documents and attention cost (the sum of squared lengths of
its texts). Texts go longest first; of the containers in which a text fits in every respect, the one is taken whose residual
capacities are left with the smallest weighted norm ('norm'), or have the largest weighted dot product with the text's needs
('dot'). A text is split only if it alone has more tokens than a container: into full containers and a rest, which is packed
like any other.

Texts are turned to numbers of tokens where they are read; only these numbers are shuffled, to blocks of about BLOCK pieces by a hash
of the text's id, and each block is packed. The few containers of a block that are not full are taken apart again, and their pieces packed
together, again in blocks. Blocks depend on the table alone, so the same table gives the same containers on any cluster.
"""

from __future__ import annotations

import base64
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidelog.functions.scale import shared_dir, written
from tidelog.llm.words import runs

CAPACITY = 2_048
MOST_DOCUMENTS = 128
BLOCK = 16_384
FULL = 0.995
WEIGHTS = (1.0, 0.02, 0.02)
# Fixed value: how the tokenizer's vocabulary takes text apart before its merges.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

_encodings: dict = {}


def encoding(uri: str):
    """The tokenizer of a file of ranks (a path or URI); it is read once a process."""
    if uri not in _encodings:
        import tiktoken

        fs, path = pafs.FileSystem.from_uri(uri)
        with fs.open_input_stream(path) as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f.read().splitlines())}
        _encodings[uri] = tiktoken.Encoding(uri, pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    return _encodings[uri]


def shipped(spark: SparkSession, path: str) -> str:
    """The tokenizer's file, which the driver can open, in the shared folder, from where executors read it."""
    fs, name = pafs.FileSystem.from_uri(path)
    folder = shared_dir(spark, "tokenizer")
    out, root = pafs.FileSystem.from_uri(folder)
    out.create_dir(root, recursive=True)
    with fs.open_input_stream(name) as f, out.open_output_stream(f"{root}/ranks") as g:
        g.write(f.read())
    return f"{folder}/ranks"


def pieces(n_tokens: int, capacity: int) -> list[tuple[int, int]]:
    """(first token, number of tokens) of the pieces of a text: itself if it fits, else full ones and a rest."""
    if n_tokens <= capacity:
        return [(0, n_tokens)]
    return [(at, min(capacity, n_tokens - at)) for at in range(0, n_tokens, capacity)]


def best_fit(sizes: np.ndarray, capacity: int = CAPACITY, documents: int = MOST_DOCUMENTS, cost: float | None = None, rule: str = "norm", weights: tuple[float, float, float] = WEIGHTS) -> np.ndarray:
    """Container of each text, by its number of tokens. cost: most attention cost of a container (None: that of one full text)."""
    if rule not in ("norm", "dot"):
        raise ValueError(rule)
    most = float(capacity) ** 2 if cost is None else float(cost)
    n = len(sizes)
    if n and (sizes.max() > capacity or float(sizes.max()) ** 2 > most):
        raise ValueError("a text is larger than a container")
    out = np.full(n, -1, np.int64)
    # residual capacities of open containers, as shares of the whole
    room, name, n_open, made = np.empty((3, 64)), np.empty(64, np.int64), 0, 0
    w = np.array(weights)[:, None]
    order = np.argsort(-sizes, kind="stable")
    least = np.array([sizes.min() / capacity if n else 0, 1 / documents, float(sizes.min()) ** 2 / most if n else 0])
    slack = 1e-9
    for i in order:
        need = np.array([sizes[i] / capacity, 1 / documents, float(sizes[i]) ** 2 / most])
        left = room[:, :n_open] - need[:, None]
        fits = np.flatnonzero((left >= -slack).all(0))
        if len(fits):
            if rule == "norm":
                k = fits[np.argmin((w * left[:, fits] ** 2).sum(0))]
            else:
                k = fits[np.argmax((w * need[:, None] * room[:, fits]).sum(0))]
            room[:, k] = left[:, k]
        else:
            if n_open == room.shape[1]:
                room, name = np.concatenate([room, np.empty_like(room)], 1), np.concatenate([name, np.empty_like(name)])
            k = n_open
            room[:, k], name[k] = 1 - need, made
            n_open, made = n_open + 1, made + 1
        out[i] = name[k]
        if (room[:, k] < least - slack).any():  # nothing fits any more
            n_open -= 1
            room[:, k], name[k] = room[:, n_open], name[n_open]
    return out


def pack(documents: DataFrame, tokenizer: str, capacity: int = CAPACITY, most_documents: int = MOST_DOCUMENTS, cost: float | None = None, rule: str = "norm", weights: tuple[float, float, float] = WEIGHTS, block: int = BLOCK) -> DataFrame:
    """container, doc_id, first_token, n_tokens: one row for each text, or for each piece of a text that is larger than a container.

    documents: doc_id, text; other columns are ignored. tokenizer: path or URI of a file of ranks that the driver can open. Null texts are left
    out; an empty text is a document of no tokens; a repeated row is packed each time; an empty table gives no rows. A container's
    attention cost is the sum of the squares of its pieces' tokens; where `cost` is less than the square of the capacity, a larger text than its
    root is split too. Containers are numbered uniquely, not densely.
    """
    if cost is not None and cost < 1:
        raise ValueError("no text fits")
    most = capacity if cost is None else min(capacity, math.isqrt(int(cost)))
    key = dict(documents.dtypes)["doc_id"]
    names = ["container", "doc_id", "first_token", "n_tokens", "full"]
    uri = shipped(documents.sparkSession, tokenizer)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoding(uri)
        for b in batches:
            texts = b.column("text").to_pylist()
            sizes = [len(t) for lo, hi in runs(texts) for t in enc.encode_ordinary_batch(texts[lo:hi], num_threads=1)]
            rows = [(k, at, n) for k, size in enumerate(sizes) for at, n in pieces(size, most)]
            of, at, n = (pa.array(x, pa.int64()) for x in (zip(*rows) if rows else ((), (), ())))
            yield pa.RecordBatch.from_arrays([b.column("doc_id").take(of), at, n], ["doc_id", "first_token", "n_tokens"])

    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come by block: one block at a time is held."""
        now, held = None, []

        def out() -> pa.RecordBatch:
            t = pa.Table.from_batches(held).combine_chunks()
            sizes = t["n_tokens"].to_numpy()
            bins = best_fit(sizes, capacity, most_documents, cost, rule, weights)
            full = (np.bincount(bins, sizes) >= FULL * capacity) | (np.bincount(bins) >= most_documents)
            if cost is not None:
                full |= np.bincount(bins, sizes.astype(float) ** 2) >= FULL * cost
            return pa.RecordBatch.from_arrays([pa.array((now << 24) + bins), *(t[c].combine_chunks() for c in names[1:4]), pa.array(full[bins])], names)

        for b in batches:
            block_of = b.column("block").to_numpy()
            edges = [0, *(np.flatnonzero(np.diff(block_of)) + 1).tolist(), len(block_of)]
            for lo, hi in zip(edges, edges[1:]):
                if lo == hi:
                    continue
                if block_of[lo] != now:
                    if held:
                        yield out()
                    now, held = int(block_of[lo]), []
                held.append(b.slice(lo, hi - lo))
        if held:
            yield out()

    def packed(d: DataFrame, n: int, base: int) -> DataFrame:
        blocks = max(1, -(-n // block))
        d = d.select("doc_id", "first_token", "n_tokens", (F.pmod(F.xxhash64("doc_id", "first_token"), F.lit(blocks)) + base).alias("block"))
        d = d.repartition(blocks, "block").sortWithinPartitions("block", F.desc("n_tokens"), "doc_id", "first_token")
        return d.mapInArrow(fill, f"container bigint, doc_id {key}, first_token bigint, n_tokens bigint, full boolean")

    sizes = written(documents.where("text is not null").select("doc_id", "text").mapInArrow(count, f"doc_id {key}, first_token bigint, n_tokens bigint"), "sizes")
    made = written(packed(sizes, sizes.count(), 0), "containers")
    rest = made.where("not full")
    return made.where("full").unionByName(packed(rest, rest.count(), 1 << 36)).drop("full")
