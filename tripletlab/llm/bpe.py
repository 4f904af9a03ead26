"""Op 3: byte-level BPE as a deterministic automaton over tokens.

``Automaton`` starts as one state that loops on all 256 bytes and is rewritten
once per merge, in merge order.  The gadget for the merge (u, v) -> w makes, out
of the state p that u leads to, a copy without the arc v, redirects u to the
copy, and lets w start wherever u could start, leading to where v leads.  What
the finished automaton accepts are exactly the merge results, so every byte
string has one path that spells it.  States are kept as deltas (parent state,
arc removed), because a full table would hold 50,000 x 50,000 arcs; the arc
test is table look-ups along those deltas and is remembered per state and token.

Encoding is table driven: pre-split words walk a trie of token spellings, and an
arc (state, token) that exists extends the only path to that position.  Time is
linear in the length of the word.  Decoding emits the label of each arc.

Defined cases: null or empty text gives no tokens and the empty text; a text may
be of any length; strings of special tokens become those tokens, as in the
tokenizers library; repeated rows give repeated rows; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import json
import os
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession

DEFAULT_FILE = "byte_bpe_50k.json"
#: Pre-split rule of byte-level BPE files (public format, fixed value).
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def tokenizer_path(name: str = DEFAULT_FILE) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def byte_alphabet() -> dict[str, int]:
    """Printable stand-ins of the 256 bytes in byte-level BPE files: printable
    Latin-1 characters stand for themselves, the others are numbered from 256."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Automaton:
    def __init__(self, labels: list[bytes], merges: list[tuple[int, int, int]], byte_ids: list[int]) -> None:
        """labels: spelling of each token id; merges: (u, v, w) in merge order."""
        n = len(labels)
        self.labels = labels
        self.left, self.right = [-1] * n, [-1] * n  # u, v of the merge that made a token
        self.born = [-1] * n  # its number; bytes are there from the start
        self.to = [-1] * n  # state that a token leads to
        self.parent, self.lost, self.made = [-1], [-1], [-1]  # of each state
        self.gone: dict[int, int] = {}  # (token redirected, arc lost) -> time
        self._n = n
        for t in byte_ids:
            self.to[t] = 0
        for k, (u, v, w) in enumerate(merges):
            self._gadget(k, u, v, w)
        self._arc: dict[int, bool] = {}
        # trie of spellings that can be reached, as (first byte) -> nested dicts
        self.trie: dict = {}
        for t in range(n):
            if self.to[t] >= 0:
                node = self.trie
                for b in labels[t]:
                    node = node.setdefault(b, {})
                node[-1] = t

    def _gadget(self, k: int, u: int, v: int, w: int) -> None:
        p = self.to[u]
        self.left[w], self.right[w], self.born[w], self.to[w] = u, v, k, self.to[v]
        self.parent.append(p)
        self.lost.append(v)
        self.made.append(k)
        self.to[u] = len(self.parent) - 1
        self.gone[u * self._n + v] = k

    def arc(self, last: int, token: int) -> bool:
        """Whether ``token`` may follow in the state that ``last`` leads to."""
        key = last * self._n + token
        known = self._arc.get(key)
        if known is None:
            known = self._walk(last, token)
            if len(self._arc) >= 2_000_000:
                self._arc.clear()
            self._arc[key] = known
        return known

    def _walk(self, last: int, token: int) -> bool:
        """Go back along the deltas of the state: the gadgets that redirected
        ``last`` itself, then those that its right part had seen before it was
        born, and so on.  ``limit`` is the time at which a delta counts no more."""
        born, n, gone = self.born, self._n, self.gone
        limit = len(self.parent)
        while True:
            birth = born[token]
            while True:
                when = gone.get(last * n + token)
                if when is not None and when < limit:
                    return False
                if born[last] <= birth:
                    break
                limit = min(limit, born[last])
                last = self.right[last]
            if birth < 0:
                return True
            # at its birth the token could start wherever its left part could
            limit = min(limit, birth + 1)
            token = self.left[token]

    def encode(self, word: bytes) -> tuple[int, ...]:
        """Tokens of a word: follow the longest arc that exists, step back where
        it leads nowhere.  A prefix has one path only, so no position is entered
        twice and the work stays linear."""
        n = len(word)
        trie, known, walk, size = self.trie, self._arc, self.arc, self._n
        path: list[int] = []
        todo: list[list[tuple[int, int]]] = []
        seen = bytearray(n + 1)
        i, last = 0, -1
        while i < n:
            found: list[tuple[int, int]] = []
            node, j = trie, i
            while j < n and (node := node.get(word[j])) is not None:
                j += 1
                if -1 in node and not seen[j]:
                    found.append((j, node[-1]))
            while True:
                while found:
                    j, t = found.pop()
                    if last < 0:
                        break
                    ok = known.get(last * size + t)
                    if (walk(last, t) if ok is None else ok) and not seen[j]:
                        break
                else:  # dead end: back to the position before
                    found = todo.pop()
                    path.pop()
                    last = path[-1] if path else -1
                    continue
                break
            seen[j] = 1
            todo.append(found)
            path.append(t)
            i, last = j, t
        return tuple(path)


class Tokenizer:
    """Pre-split, automaton and labels of one tokenizer file."""

    CACHE_WORDS, CACHE_LENGTH = 800_000, 48

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        vocab, alphabet = spec["model"]["vocab"], byte_alphabet()
        special = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        n = max([*vocab.values(), *special.values()]) + 1
        labels = [b""] * n
        for text, i in vocab.items():
            labels[i] = bytes(alphabet[c] for c in text)
        for text, i in special.items():
            labels[i] = text.encode()
        pairs = (m if isinstance(m, list) else m.split(" ") for m in spec["model"]["merges"])
        merges = [(vocab[a], vocab[b], vocab[a + b]) for a, b in pairs]
        self.automaton = Automaton(labels, merges, [vocab[c] for c in alphabet])
        self.labels, self.names = labels, [str(i) for i in range(n)]
        self.special = special
        self._cut = regex.compile("(" + "|".join(map(regex.escape, special)) + ")") if special else None
        self._split = regex.compile(SPLIT)
        self._known: dict[str, tuple[int, ...]] = {}

    def _word(self, word: str) -> tuple[int, ...]:
        ids = self.automaton.encode(word.encode())
        if len(word) <= self.CACHE_LENGTH:
            if len(self._known) >= self.CACHE_WORDS:
                self._known.clear()
            self._known[word] = ids
        return ids

    def encode(self, text: str | None) -> list[int]:
        out: list[int] = []
        if not text:
            return out
        for part in self._cut.split(text) if self._cut else [text]:
            if part in self.special:
                out.append(self.special[part])
                continue
            get = self._known.get
            for word in self._split.findall(part):
                out += get(word) or self._word(word)
        return out

    def decode(self, ids: list[int]) -> str:
        return b"".join(map(self.labels.__getitem__, ids)).decode("utf-8", "replace")


@lru_cache(maxsize=2)
def load(path: str) -> Tokenizer:
    return Tokenizer(path)


def encode(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None, ids: bool = True, digests: bool = False) -> DataFrame:
    """One row per document: id, n_tokens, and as asked for the token ids
    (``ids``) or the SHA-256 of ids and of the decoded text (``digests``)."""
    path = path or tokenizer_path()
    kind = docs.schema[id_col].dataType.simpleString()
    schema = f"`{id_col}` {kind}, n_tokens long" + ", ids array<int>" * ids + ", ids_sha256 string, decoded_sha256 string" * digests
    id_type = None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tok = load(path if os.path.exists(path) else tokenizer_path(os.path.basename(path)))
        names = tok.names.__getitem__
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                count, all_ids, sha, back = [], [], [], []
                for text in part.column(1):
                    found = tok.encode(text.as_py())
                    count.append(len(found))
                    if ids:
                        all_ids.append(found)
                    if digests:
                        sha.append(hashlib.sha256(",".join(map(names, found)).encode()).hexdigest())
                        back.append(hashlib.sha256(tok.decode(found).encode()).hexdigest())
                cols = [part.column(0), pa.array(count, pa.int64())]
                cols += [pa.array(all_ids, pa.list_(pa.int32()))] * ids + [pa.array(sha, pa.string()), pa.array(back, pa.string())] * digests
                yield pa.RecordBatch.from_arrays(cols, [id_col, "n_tokens"] + ["ids"] * ids + ["ids_sha256", "decoded_sha256"] * digests)

    return docs.select(id_col, text_col).mapInArrow(run, schema)


def decode(tokens: DataFrame, id_col: str = "doc_id", ids_col: str = "ids", path: str | None = None) -> DataFrame:
    """Texts of token id lists: (id, text); a null list gives the empty text."""
    path = path or tokenizer_path()
    kind = tokens.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tok = load(path)
        for batch in batches:
            texts = [tok.decode(x.as_py() or []) for x in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], [id_col, "text"])

    return tokens.select(id_col, ids_col).mapInArrow(run, f"`{id_col}` {kind}, text string")


def op3_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return encode(docs, ids=False, digests=True)
