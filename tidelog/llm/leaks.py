"""Evaluation texts that leak into training text: every document that holds a stretch of a test item, and which items.

Method: each shard of documents becomes an FM-index over its words. All phrases of SEED words of the items are searched
backward in it, through the ranks of a wavelet matrix, and their occurrences located by sampled suffix positions. Occurrences of
a document and item are joined to spans, by an exact comparison of words, across single changed, lost or added words and
across interruptions in the document. A span of MIN_WORDS words of the item is a leak; the spans of all items in a document
are merged to the passages that would have to be removed.

Items are the query set. They are numbered in blocks of at most BLOCK_WORDS words, each written once to the shared folder, and
every task reads one block at a time; nothing of them goes to the driver but the blocks' names. Documents are never shuffled.
A stretch that holds no SEED unchanged words in a row has no occurrence and isn't found: its slips aren't isolated.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidelog.functions.scale import shared_dir, written
from tidelog.llm.fmindex import FMIndex
from tidelog.llm.words import words, words_with_places

SEED = 5
MIN_WORDS = 15
SHARD_WORDS = 1 << 20
BLOCK_WORDS = 500_000  # a number of a word is a character of `as_text`, of which there are twice as many
LAP_WORDS = 256  # an item longer than a block is taken in parts that overlap by so many
SLIP = 2  # words in a row that may differ
INTERRUPTION = 40  # words that may stand between
SURE = 4  # words that must match after an interruption
SHARE = 0.75  # of a span's words that must be the item's
MIN_MATCHED = MIN_WORDS - 1  # one of the fewest words may be a slip


class Items:
    """A block of test items as word numbers: 2 and above; 0 is the end of a document, 1 any word that no item has."""

    def __init__(self, ids: list, texts: list[str | None]):
        self.prepare(ids, [words(t) for t in texts])

    @staticmethod
    def of_words(ids: list, texts: list[list[str]]) -> Items:
        new = Items.__new__(Items)
        new.prepare(ids, texts)
        return new

    def prepare(self, ids: list, texts: list[list[str]]) -> None:
        self.ids = ids
        self.vocabulary: dict[str, int] = {}
        self.words = [[self.vocabulary.setdefault(w, len(self.vocabulary) + 2) for w in t] for t in texts]
        self.texts = [as_text(w) for w in self.words]
        self.numbers = np.array([x for w in self.words for x in w], np.int64)
        length = np.array([len(w) for w in self.words], np.int64)
        begin = np.cumsum(length) - length
        n = np.maximum(length - SEED + 1, 0)
        # places of seeds, in order of the seed: count and offset are those of each different one
        item = np.repeat(np.arange(len(n)), n)
        at = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        all_seeds = self.numbers[(begin[item] + at)[:, None] + np.arange(SEED)] if len(item) else np.zeros((0, SEED), np.int64)
        order = np.lexsort(all_seeds.T[::-1])
        all_seeds, self.item, self.at = all_seeds[order], item[order], at[order]
        new = np.ones(len(order), bool)
        new[1:] = (all_seeds[1:] != all_seeds[:-1]).any(1)
        self.seeds = all_seeds[new]
        self.offset = np.append(np.flatnonzero(new), len(order))
        self.count = np.diff(self.offset)

    @property
    def n_symbols(self) -> int:
        return len(self.vocabulary) + 2


_blocks: dict[str, Items] = {}


def block_of(uri: str) -> Items:
    """A block of items from the shared folder; a worker keeps the last it has read."""
    if uri not in _blocks:
        fs, path = pafs.FileSystem.from_uri(uri)
        with fs.open_input_stream(path) as f:
            got = Items.__new__(Items)
            vars(got).update(pickle.loads(f.read()))
        _blocks.clear()
        _blocks[uri] = got
    return _blocks[uri]


def write_blocks(items: DataFrame) -> list[str]:
    """Items (item_id, text) in blocks in the shared folder; their URIs. Null ids are left out, and items of fewer than MIN_WORDS words."""
    folder, most, lap, least = shared_dir(items.sparkSession, "items"), BLOCK_WORDS, LAP_WORDS, MIN_WORDS

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        fs, root = pafs.FileSystem.from_uri(folder)
        fs.create_dir(root, recursive=True)
        ids, texts, size, n = [], [], 0, 0

        def out() -> pa.RecordBatch:
            name = f"{TaskContext.get().taskAttemptId()}-{n}"
            with fs.open_output_stream(f"{root}/{name}") as f:
                f.write(pickle.dumps(vars(Items.of_words(ids, texts))))  # its attributes: a class that is shipped with a task can't be pickled
            return pa.RecordBatch.from_arrays([pa.array([f"{folder}/{name}"])], ["block"])

        for b in batches:
            for i, t in zip(b.column("item_id").to_pylist(), b.column("text").to_pylist()):
                w = words(t)
                for part in [w] if len(w) <= most else [w[k : k + most] for k in range(0, len(w) - lap, most - lap)]:
                    if len(part) < least:
                        continue
                    if texts and size + len(part) > most:
                        yield out()
                        ids, texts, size, n = [], [], 0, n + 1
                    ids.append(i)
                    texts.append(part)
                    size += len(part)
        if texts:
            yield out()

    d = items.where("item_id is not null and text is not null").select("item_id", "text")
    total = d.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("n")).first().n
    parts = max(1, -(-total // (4 * BLOCK_WORDS)))
    # one short row a block comes to the driver
    return sorted(r.block for r in written(d.repartition(parts, F.xxhash64("item_id", "text")).mapInArrow(apply, "block string"), "item-blocks").collect())


def occurrences(items: Items, docs: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Document, position in it, item and position in that, of each occurrence of a seed, in that order; by the shard's FM-index."""
    length = np.array([len(d) for d in docs], np.int64)
    if not len(items.seeds) or not length.sum():
        return (np.zeros(0, np.int64),) * 4
    s = np.zeros(int(length.sum()) + len(docs), np.int64)
    start = np.concatenate([[0], np.cumsum(length + 1)[:-1]])
    body = np.ones(len(s), bool)
    body[start + length] = False
    s[body] = np.concatenate(docs)
    # words of no item only part others: a run of them, and the end of a document beside it, is one symbol
    idle = s < 2
    keep = ~idle | np.append(True, ~idle[:-1])
    place = np.flatnonzero(keep)
    index = FMIndex(s[keep], items.n_symbols)
    low, high = index.search(items.seeds)
    n = high - low
    seed = np.repeat(np.arange(len(n)), n)
    row = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(low, n)
    position = place[index.locate(row)]
    doc = np.searchsorted(start, position, "right") - 1
    # each occurrence, for each place of the seed in the items
    times = items.count[seed]
    each = np.repeat(np.arange(len(seed)), times)
    where = np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times) + np.repeat(items.offset[seed], times)
    doc, position, item, at = doc[each], (position - start[doc])[each], items.item[where], items.at[where]
    order = np.lexsort((at, position, item, doc))
    return doc[order], position[order], item[order], at[order]


def as_text(numbers: list[int]) -> str:
    """Word numbers as one character each, so that comparing and finding runs of words is one call."""
    return "".join([chr(n if n < 0xD800 else n + 0x800) for n in numbers])


def grow(d: str, t: str, p: int, q: int) -> tuple[int, int, int]:
    """From words d[p:] and t[q:] on (both come after a match), over slips and interruptions: one past the last matching words of d
    and t, and the number matched."""
    end_p, end_q, matched = p, q, 0
    while True:
        while d[p : p + 8] == t[q : q + 8] and p + 8 <= len(d) and q + 8 <= len(t):
            p, q, matched = p + 8, q + 8, matched + 8
        while p < len(d) and q < len(t) and d[p] == t[q]:
            p, q, matched = p + 1, q + 1, matched + 1
        end_p, end_q = p, q
        best = None
        # two words must match again; the fewest words passed over first, those of the document before those of the item
        for x, y in _SLIPS:
            if d[p + x : p + x + 2] == t[q + y : q + y + 2] and q + y + 2 <= len(t):
                best = x, y
                break
        if best is None:
            for y in (0, 1):
                if q + y + SURE <= len(t):
                    x = d.find(t[q + y : q + y + SURE], p, p + INTERRUPTION + SURE)
                    if x >= 0 and (best is None or x - p < best[0]):
                        best = x - p, y
        if best is None:
            return end_p, end_q, matched
        p, q = p + best[0], q + best[1]


_SLIPS = sorted(((x, y) for x in range(SLIP + 1) for y in range(SLIP + 1) if x or y), key=lambda c: (c[0] + c[1], c[1]))


def spans(d: str, t: str, hits: list[tuple[int, int]]) -> list[tuple[int, int, int, int]]:
    """Stretches that document d and item t share, from seeds (position in d, in t): first and last word in d, words of t, matched."""
    out: list[tuple[int, int, int, int]] = []
    within: list[tuple[int, int, int, int]] = []
    back_d = back_t = ""
    for p, q in hits:
        # seeds inside a stretch would find it again
        if any(a <= p < b and c <= q < e for a, b, c, e in within):
            continue
        back_d, back_t = back_d or d[::-1], back_t or t[::-1]
        lp, lq, left = grow(back_d, back_t, len(d) - p, len(t) - q)
        rp, rq, right = grow(d, t, p, q)
        lp, lq = len(d) - lp, len(t) - lq
        within.append((lp, rp, lq, rq))
        out.append((lp, rp - 1, rq - lq, left + right))
    return out


def is_leak(span: tuple[int, int, int, int]) -> bool:
    return span[2] >= MIN_WORDS and span[3] >= max(MIN_MATCHED, SHARE * span[2])


def extends(d: np.ndarray, start: np.ndarray, end: np.ndarray, p: np.ndarray, t: np.ndarray, begin: np.ndarray, stop: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Whether grow() could take one step to the right of seeds that end before d[p] and t[q], where these two words differ or aren't there.

    d and t hold all documents and items, whose bounds are start, end, begin and stop for each seed. To the left: give all reversed.
    """

    def same(x: int, y: int, n: int) -> np.ndarray:
        i, j = p + x, q + y
        ok = (i + n <= end) & (j + n <= stop)
        for k in range(n):
            ok &= d[np.minimum(i + k, len(d) - 1)] == t[np.minimum(j + k, len(t) - 1)]
        return ok

    out = np.zeros(len(p), bool)
    for x, y in _SLIPS:
        out |= same(x, y, 2)
    for y in (0, 1):
        for x in range(INTERRUPTION + 1):
            out |= same(x, y, SURE)
    return out


def find(items: Items, texts: list[str | None]) -> list[tuple[int, int, list[tuple[int, int, int, int]]]]:
    """(number of the text, number of the item, its leaked spans) of a shard of texts."""
    return find_words(items, [words(t) for t in texts])


def find_words(items: Items, texts: list[list[str]]) -> list[tuple[int, int, list[tuple[int, int, int, int]]]]:
    """find() in texts that are taken into words already."""
    get = items.vocabulary.get
    docs = [np.fromiter(map(get, t, repeat(1)), np.int64, len(t)) for t in texts]
    doc, p, item, q = occurrences(items, docs)
    if not len(doc):
        return []
    new = np.ones(len(doc), bool)
    new[1:] = (doc[1:] != doc[:-1]) | (item[1:] != item[:-1])
    edge = np.append(np.flatnonzero(new), len(doc))
    # of pairs with one seed alone most can be seen to end on both sides of it, all at once
    chosen = np.diff(edge) > 1
    one = np.flatnonzero(~chosen)
    if len(one):
        at = edge[one]
        d, t = np.concatenate(docs), items.numbers
        ends, stops = np.cumsum([len(x) for x in docs]), np.cumsum([len(x) for x in items.words])
        start, end = ends[doc[at]] - [len(docs[n]) for n in doc[at].tolist()], ends[doc[at]]
        begin, stop = stops[item[at]] - [len(items.words[m]) for m in item[at].tolist()], stops[item[at]]
        right = extends(d, start, end, start + p[at] + SEED, t, begin, stop, begin + q[at] + SEED)
        nd, nt = len(d), len(t)
        left = extends(d[::-1], nd - end, nd - start, nd - start - p[at], t[::-1], nt - stop, nt - begin, nt - begin - q[at])
        chosen[one] = right | left
    found, at, text = [], -1, ""
    for a, b in zip(edge[:-1][chosen].tolist(), edge[1:][chosen].tolist()):
        n, m = int(doc[a]), int(item[a])
        if n != at:
            at, text = n, as_text(docs[n].tolist())
        got = [s for s in spans(text, items.texts[m], list(zip(p[a:b].tolist(), q[a:b].tolist()))) if is_leak(s)]
        if got:
            found.append((n, m, got))
    return found


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int, int]]:
    """(first, last, how many) of spans of words that overlap or follow one another."""
    out: list[list[int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1] + 1:
            out[-1][1], out[-1][2] = max(out[-1][1], b), out[-1][2] + 1
        else:
            out.append([a, b, 1])
    return [tuple(x) for x in out]


def _search(documents: DataFrame, items: DataFrame, schema: str, rows_of) -> DataFrame:
    """Shards of documents against all blocks of items. rows_of(doc_id, text, [(item_id, spans)]) makes the rows of a document with leaks."""
    blocks = write_blocks(items)
    documents = documents.where("text is not null").select("doc_id", "text")

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        size = 0

        def out(types: pa.Schema) -> Iterator[pa.RecordBatch]:
            got: dict[int, dict] = {}
            texts = [words(x[1]) for x in held]
            for uri in blocks:
                block = block_of(uri)
                for n, m, s in find_words(block, texts):
                    got.setdefault(n, {}).setdefault(block.ids[m], []).extend(s)
            rows = [r for n in sorted(got) for r in rows_of(*held[n], list(got[n].items()))]
            if rows:
                yield pa.RecordBatch.from_pylist(rows, types)

        types = None
        for b in batches:
            types = types or pa.schema([pa.field("doc_id", b.column("doc_id").type), *rest])
            for row in zip(b.column("doc_id").to_pylist(), b.column("text").to_pylist()):
                held.append(row)
                size += len(row[1]) // 6
                if size >= SHARD_WORDS:
                    yield from out(types)
                    held, size = [], 0
        if held:
            yield from out(types)

    from pyspark.sql.pandas.types import to_arrow_schema

    rest = list(to_arrow_schema(documents.sparkSession.createDataFrame([], schema).schema))
    return documents.mapInArrow(apply, f"doc_id {dict(documents.dtypes)['doc_id']}, {schema}")


def leaks(documents: DataFrame, items: DataFrame) -> DataFrame:
    """doc_id, item_id, first_word, last_word, n_words, n_matched and longest, for every stretch of MIN_WORDS words of an item in a document.

    documents: doc_id, text. items: item_id, text. first_word and last_word count the document's words from 0; n_words are those of the
    item, n_matched how many of them are the same; longest is true for one stretch of each document and item. Null and empty texts
    hold nothing; items of the same text are all named; a repeated row of documents is reported each time; other columns are ignored.
    """

    def rows_of(doc_id, text: str, found: list) -> Iterator[dict]:
        for item, all_spans in found:
            all_spans = sorted(set(all_spans))
            best = max(all_spans, key=lambda x: (x[2], x[3], -x[0], -x[1]))
            for s in all_spans:
                yield {"doc_id": doc_id, "item_id": item, "first_word": s[0], "last_word": s[1], "n_words": s[2], "n_matched": s[3], "longest": s == best}

    return _search(documents, items, f"item_id {dict(items.dtypes)['item_id']}, first_word bigint, last_word bigint, n_words bigint, n_matched bigint, longest boolean", rows_of)


def removals(documents: DataFrame, items: DataFrame) -> DataFrame:
    """doc_id, first_word, last_word, first_char, end_char and n_spans of each passage to be removed: the stretches of all items in a
    document, merged where they overlap or follow one another. Characters count from 0, and end_char is one past the last. Documents as
    in leaks()."""

    def rows_of(doc_id, text: str, found: list) -> Iterator[dict]:
        places = words_with_places(text)[1]
        for a, b, n in merged([s[:2] for _, all_spans in found for s in set(all_spans)]):
            yield {"doc_id": doc_id, "first_word": a, "last_word": b, "first_char": places[a][0], "end_char": places[b][1], "n_spans": n}

    return _search(documents, items, "first_word bigint, last_word bigint, first_char bigint, end_char bigint, n_spans bigint", rows_of)
