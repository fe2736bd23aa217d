"""Best-fit packing of token sequences by linear grouping.

Tokens are counted once per document. What the packing needs of all documents
is one number per length, so the plan is made on a table of at most ``capacity``
counts, however large the corpus:

1. lengths over a bound are ranked, cut into groups of equal cardinality, and
   rounded up to the largest of their group;
2. over these few sizes, column generation finds the configurations (multisets
   of sizes that fit a sequence) that need the fewest sequences;
3. actual lengths take the places of the rounded ones, group by group;
4. what is left over, and then the small lengths, go where they fit best.

The plan lists runs: the documents of one length with ranks from..to lie in
these sequences at this offset. A document finds its run by its rank among the
documents of its length, counted by hash bucket and then added up.
"""

from __future__ import annotations

import re
import struct
import zlib
from collections import defaultdict

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from phylospark.shared import cut

#: Texts of these characters only are split into words by Python's re; others go to the tokenizer whole.
PLAIN = re.compile(r"[\t\n\v\f\r\x20-\x7eÀ-ɏ‐-‧]*")
#: The pre-tokenizer's pattern for such texts. Fixed by the vocabulary.
WORDS = re.compile(r"'(?:[stmd]|re|ve|ll)| ?[^\W\d_]+| ?\d+| ?(?:[^\s\w]|_)+|\s+(?!\S)|\s+")
#: Words whose ids a task remembers, at most (about 100 MB).
REMEMBERED = 700_000
#: Rows of a hash bucket, about.
BUCKET_ROWS = 1_000_000


def byte_letters() -> dict[int, int]:
    """The letter for which each byte stands in a byte-level vocabulary: printable ones themselves, others from 256 on."""
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in printable]
    return {b: b for b in printable} | {b: 256 + i for i, b in enumerate(others)}


BYTE_LETTERS = byte_letters()


class WordIds(dict):
    """Word -> its ids as little-endian unsigned 32-bit numbers, filled from the tokenizer's model."""

    def __init__(self, tokenizer):
        super().__init__()
        self.tokenizer = tokenizer

    def __missing__(self, word: str) -> bytes:
        if len(self) >= REMEMBERED:
            self.clear()
        letters = word.encode("utf-8").decode("latin-1").translate(BYTE_LETTERS)
        ids = [t.id for t in self.tokenizer.model.tokenize(letters)]
        self[word] = packed = struct.pack(f"<{len(ids)}I", *ids)
        return packed


def open_tokenizer(path: str):
    """The tokenizer at ``path`` and a function that gives a text's ids as bytes."""
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    special = [t.content for t in tokenizer.get_added_tokens_decoder().values()]
    known = WordIds(tokenizer)

    def encode(text: str) -> bytes:
        if PLAIN.fullmatch(text) and not any(s in text for s in special):
            return b"".join(map(known.__getitem__, WORDS.findall(text)))
        return np.array(tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    return encode


def token_pieces(docs: DataFrame, tokenizer_path: str, capacity: int = 2048, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Documents as pieces of at most ``capacity`` ids: ``doc_id, piece, start, length, ids_crc32``.

    A document is its ids and then ``end_id``; a null text is empty. Only longer
    documents are cut; all pieces but the first are full.
    """
    end = np.array([end_id], "<u4").tobytes()

    def pieces(batches):
        encode = open_tokenizer(tokenizer_path)
        for batch in batches:
            rows = []
            for doc, text in zip(batch["doc_id"], batch["text"]):
                ids = encode(text or "") + end
                n = len(ids) // 4
                at, to = 0, (n - 1) % capacity + 1
                piece = 0
                while at < n:
                    rows.append((doc, piece, at, to - at, zlib.crc32(ids[4 * at : 4 * to])))
                    piece, at, to = piece + 1, to, to + capacity
            columns = list(zip(*rows)) or [[]] * 5
            yield pd.DataFrame({"doc_id": pd.array(columns[0], "Int64"), "piece": np.array(columns[1], np.int32), "start": np.array(columns[2], np.int64), "length": np.array(columns[3], np.int64), "ids_crc32": np.array(columns[4], np.int64)})

    chosen = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return chosen.mapInArrow(_with_ids(pieces), "doc_id long, piece int, start long, length long, ids_crc32 long")


def _with_ids(function):
    """Lets a function of pandas batches keep nullable integer ids."""
    import pyarrow as pa

    def run(batches):
        frames = (b.to_pandas(types_mapper={pa.int64(): pd.Int64Dtype()}.get) for b in batches)
        for out in function(frames):
            yield from pa.Table.from_pandas(out, preserve_index=False).to_batches()

    return run


def configurations(sizes: np.ndarray, counts: np.ndarray, capacity: int, rounds: int = 400) -> list[tuple[np.ndarray, float]]:
    """Columns and multiplicities of a least cover of ``counts`` items of each size (Gilmore and Gomory).

    The master problem is solved by the revised simplex method, the pricing
    problem, an unbounded knapsack, by dynamic programming over capacities.
    """
    n = len(sizes)
    basis = np.diag((capacity // sizes).astype(float))
    for _ in range(rounds):
        inverse = np.linalg.inv(basis)
        dual = inverse.sum(axis=0)
        value, pick = np.zeros(capacity + 1), np.full(capacity + 1, -1)
        for c in range(int(sizes.min()), capacity + 1):
            fits = np.flatnonzero(sizes <= c)
            gain = value[c - sizes[fits]] + dual[fits]
            best = int(gain.argmax())
            if gain[best] > value[c - 1] + 1e-12:
                value[c], pick[c] = gain[best], fits[best]
            else:
                value[c] = value[c - 1]
        if value[capacity] <= 1 + 1e-9:
            break
        column, c = np.zeros(n), capacity
        while c > 0:
            if pick[c] < 0:
                c -= 1
            else:
                column[pick[c]] += 1
                c -= int(sizes[pick[c]])
        amounts, step = inverse @ counts, inverse @ column
        grows = np.flatnonzero(step > 1e-9)
        if not len(grows):
            break
        basis[:, grows[(amounts[grows] / step[grows]).argmin()]] = column
    amounts = np.linalg.inv(basis) @ counts
    return [(basis[:, i].astype(int), max(0.0, x)) for i, x in enumerate(amounts)]


class Plan:
    """Runs of equal sequences. A run is [first sequence, how many, [(length, copies)]], kept by free room."""

    def __init__(self, capacity: int):
        self.capacity, self.next, self.runs = capacity, 0, defaultdict(list)

    def open(self, many: int, content: list[tuple[int, int]]) -> None:
        if many:
            self.runs[self.capacity - sum(a * b for a, b in content)].append([self.next, many, content])
            self.next += many

    def best_fit(self, length: int, many: int) -> None:
        """Put ``many`` items where the least room remains; a run that takes only some of them is split."""
        for room in range(length, self.capacity):
            while many and self.runs[room]:
                first, n, content = self.runs[room].pop()
                each = room // length
                full = min(n, many // each)
                if full < n and many - full * each:
                    part = many - full * each
                    self.runs[room - part * length].append([first + full, 1, [*content, (length, part)]])
                    many -= part
                    if full + 1 < n:
                        self.runs[room].append([first + full + 1, n - full - 1, content])
                elif full < n:
                    self.runs[room].append([first + full, n - full, content])
                if full:
                    self.runs[room - each * length].append([first, full, [*content, (length, each)]])
                    many -= full * each
            if not many:
                return
        each = self.capacity // length
        self.open(many // each, [(length, each)])
        self.open(int(many % each > 0), [(length, many % each)])

    def rows(self) -> list[tuple[int, int, int, int, int, int]]:
        """(length, first rank, last rank + 1, first sequence, copies in each, offset)."""
        given, out = defaultdict(int), []
        for runs in list(self.runs.values()):
            for first, many, content in runs:
                at = 0
                for length, copies in content:
                    out.append((length, given[length], given[length] + many * copies, first, copies, at))
                    given[length] += many * copies
                    at += length * copies
        return out


def pack_lengths(counts: dict[int, int], capacity: int = 2048, groups: int = 96, small: float = 0.45) -> Plan:
    """Plan for ``counts`` pieces of each length, all at most ``capacity``."""
    plan = Plan(capacity)
    plan.open(counts.get(capacity, 0), [(capacity, 1)])
    bound = int(small * capacity)
    large = sorted((x for x in counts if bound < x < capacity), reverse=True)
    left = {x: n for x, n in counts.items() if x < capacity}
    total = sum(counts[x] for x in large)
    if total:
        per = -(-total // groups)
        queues, room = [], 0  # of each group: its lengths with counts, longest first
        for x in large:
            n = counts[x]
            while n:
                if not room:
                    queues.append([])
                    room = per
                took = min(n, room)
                queues[-1].append([x, took])
                n, room = n - took, room - took
        sizes = np.array([q[0][0] for q in queues])
        keep = np.flatnonzero(np.r_[True, sizes[1:] != sizes[:-1]])  # groups of one size are one group
        queues = [sum(queues[a:b], []) for a, b in zip(keep, [*keep[1:], len(queues)])]
        sizes = sizes[keep]
        for column, amount in configurations(sizes, np.array([float(sum(n for _, n in q)) for q in queues]), capacity):
            many = int(amount + 1e-6)
            slots = [i for i, k in enumerate(column) for _ in range(k)]
            while many and slots:
                # As many sequences as every slot can fill with one length each.
                want = defaultdict(int)
                for i in slots:
                    want[i] += 1
                if any(not queues[i] for i in want):
                    break
                heads = {i: queues[i][0] for i in want}
                run = min(many, min(h[1] // want[i] for i, h in heads.items()))
                if run:
                    content = [(heads[i][0], k) for i, k in want.items()]
                    for i, k in want.items():
                        heads[i][1] -= run * k
                        left[heads[i][0]] -= run * k
                else:  # a length runs out within one sequence
                    run, mixed = 1, defaultdict(int)
                    if any(sum(n for _, n in queues[i]) < k for i, k in want.items()):
                        break
                    for i in slots:
                        while not queues[i][0][1]:
                            queues[i].pop(0)
                        queues[i][0][1] -= 1
                        mixed[queues[i][0][0]] += 1
                        left[queues[i][0][0]] -= 1
                    content = list(mixed.items())
                plan.open(run, content)
                many -= run
                for i in want:
                    while queues[i] and not queues[i][0][1]:
                        queues[i].pop(0)
    for x in sorted(left, reverse=True):
        if left[x]:
            plan.best_fit(x, left[x])
    return plan


def pack_documents(docs: DataFrame, tokenizer_path: str, capacity: int = 2048, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text", groups: int = 96, small: float = 0.45) -> DataFrame:
    """Pack documents into few sequences of at most ``capacity`` tokens.

    Returns one row per piece: ``doc_id, piece, start, length, ids_crc32,
    sequence_id, offset``; offsets have no gaps. Every row packs, also one that
    repeats another or has a null id; a null or empty text is its end token
    alone. An empty input gives no rows. The driver holds one count per length.
    """
    pieces = cut(token_pieces(docs, tokenizer_path, capacity, end_id, id_col, text_col), batch_rows=1000)
    by_length = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}
    runs = np.array(sorted(pack_lengths(by_length, capacity, groups, small).rows()), np.int64).reshape(-1, 6)
    widest = max(by_length.values(), default=0) + 1
    keys, lo, first, copies, offset = runs[:, 0] * widest + runs[:, 1], runs[:, 1], runs[:, 3], runs[:, 4], runs[:, 5]

    buckets = max(64, sum(by_length.values()) // BUCKET_ROWS)
    dealt = pieces.withColumn("bucket", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(buckets)).cast("int"))
    in_bucket = Window.partitionBy("bucket", "length").orderBy("doc_id", "piece", "start", "ids_crc32")
    ranked = dealt.withColumn("rank", F.row_number().over(in_bucket).cast("long") - 1)
    sums = dealt.groupBy("bucket", "length").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("length").orderBy("bucket")
    starts = sums.select("bucket", "length", (F.sum("n").over(before) - F.col("n")).alias("before"))
    ranked = ranked.join(starts, ["bucket", "length"]).withColumn("rank", F.col("rank") + F.col("before")).select("doc_id", "piece", "start", "length", "ids_crc32", "rank")

    def place(frames):
        for b in frames:
            length, rank = b["length"].to_numpy(np.int64), b["rank"].to_numpy(np.int64)
            run = np.searchsorted(keys, length * widest + rank, "right") - 1
            rank = rank - lo[run]
            yield b.drop(columns="rank").assign(sequence_id=first[run] + rank // copies[run], offset=offset[run] + rank % copies[run] * length)

    return ranked.mapInArrow(_with_ids(place), "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")
