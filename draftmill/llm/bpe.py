"""Operator 5: BPE encoding and decoding by speculation and verification.

Per Arrow batch, the distinct words of all texts are encoded once:

1. speculate: greedy longest match proposes tokens for each word;
2. verify: for all distinct adjacent pairs of the batch at once, numpy undoes
   the two tokens' merges from the latest to the earliest and looks for a merge
   across their border that would have come first;
3. repair: only words with a pair that fails are merged exactly.

A proposal whose tokens are reachable and whose adjacent pairs are all
compatible is the only encoding that BPE can give, so the result is exact.

The tokenizer file is a parameter.  This module serves files of a BPE model
with byte-level symbols, an end-of-word suffix, the normalizers NFC, white
space to one space and lower case, and a pattern that splits words; it refuses
others.

Edge cases: null and empty texts have no tokens; the special tokens' own
strings in a text become their ids, as the tokenizers library does; a word of
any length is merged with a heap in n log n; decoding joins the tokens with
spaces, as the library does for files without a decoder.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import re
import unicodedata
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from tokenizers import Tokenizer

#: Texts encoded together: at most so many, and about so many characters.
ROWS_AT_ONCE, CHARS_AT_ONCE = 2500, 8_000_000
#: Other characters than these may be classed or composed otherwise by another Unicode version; texts that hold them are split by the library itself.
SETTLED = re.compile("[^\\x00-\u052f\u05d0-\u05ea\u0620-\u064a\u0904-\u0939\u0e01-\u0e3a\u2010-\u2064\u20a0-\u20bf\u2100-\u214f\u2190-\u23ff\u2500-\u27bf\u3000-\u3096\u30a0-\u30fe\u4e00-\u9fa5\uac00-\ud7a3\uff01-\uff5e\U0001f300-\U0001f64f]")
#: Encodings of words kept from batch to batch in a task; beyond it the store starts anew.
WORDS_KEPT = 300_000


def byte_symbols() -> dict[int, str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    plain = [*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)]
    rest = [b for b in range(256) if b not in plain]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(rest)}


class WordBpe:
    """Tables of one tokenizer file, and the three steps over a list of words."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model, split = spec["model"], spec["pre_tokenizer"]["pretokenizers"][0]
        kinds = [n["type"] for n in spec["normalizer"]["normalizers"]]
        if model["type"] != "BPE" or kinds != ["NFC", "Replace", "Lowercase"] or not split["invert"] or spec["decoder"] or spec["post_processor"] or model["byte_fallback"]:
            raise ValueError(f"{path}: not a word BPE file of the supported form")
        self.suffix = model["end_of_word_suffix"]
        self.pattern = regex.compile(split["pattern"]["Regex"])
        self.library = Tokenizer.from_file(path)
        self.back = {c: b for b, c in byte_symbols().items()}
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.special_pattern = re.compile("(" + "|".join(map(re.escape, self.special)) + ")")
        vocab = model["vocab"]
        size = max([*vocab.values(), *self.special.values()]) + 1
        self.token = [""] * size
        for t, i in [*vocab.items(), *self.special.items()]:
            self.token[i] = t
        symbol = byte_symbols()
        self.base = [vocab[symbol[b]] for b in range(256)]
        self.base_end = [vocab[symbol[b] + self.suffix] for b in range(256)]
        # Each token's two parts and the rank of its merge; single symbols have no parts and come before all merges.
        merges = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        left, right, rank = np.arange(size), np.arange(size), np.full(size, -1)
        self.merge: dict[tuple[int, int], tuple[int, int]] = {}
        for k, (a, b) in enumerate(merges):
            t = vocab[a + b]
            left[t], right[t], rank[t] = vocab[a], vocab[b], k
            self.merge[vocab[a], vocab[b]] = (k, t)
        self.left, self.right, self.rank, self.size = left, right, rank, size
        pairs = np.array(list(self.merge), dtype=np.int64)
        keys = pairs[:, 0] * size + pairs[:, 1]
        order = np.argsort(keys)
        self.pair_keys, self.pair_ranks = keys[order], np.array([k for k, _ in self.merge.values()])[order]
        # A token can result only if its parts can and no earlier merge crosses the border between them.
        merged = np.flatnonzero(rank >= 0)
        whole = self.compatible(left[merged], right[merged], rank[merged])
        usable = np.ones(size, bool)
        for t in merged[np.argsort(rank[merged])]:
            usable[t] = usable[left[t]] and usable[right[t]]
            if usable[t]:
                usable[t] = whole[np.searchsorted(merged, t)]
        self.inner: dict[bytes, int] = {}
        self.final: dict[bytes, int] = {}
        for t, i in vocab.items():
            if usable[i]:
                end = t.endswith(self.suffix)
                raw = bytes(self.back[c] for c in (t[: -len(self.suffix)] if end else t))
                (self.final if end else self.inner)[raw] = i
        self.longest = max(map(len, self.inner))
        self.known: dict[str, tuple[bytes, str, int]] = {}

    def compatible(self, a: np.ndarray, b: np.ndarray, limit: np.ndarray | int | None = None) -> np.ndarray:
        """Whether tokens a and b can stand side by side: no merge across their border precedes the merges that made them."""
        a, b = a.copy(), b.copy()
        limit = np.full(len(a), len(self.rank) * 2) if limit is None else np.array(limit)
        good = np.ones(len(a), bool)
        at = np.arange(len(a))
        while len(at):
            x, y = a[at], b[at]
            key = x * self.size + y
            where = np.minimum(np.searchsorted(self.pair_keys, key), len(self.pair_keys) - 1)
            crossed = (self.pair_keys[where] == key) & (self.pair_ranks[where] < limit[at])
            good[at[crossed]] = False
            rx, ry = self.rank[x], self.rank[y]
            more = ~crossed & ((rx >= 0) | (ry >= 0))
            undo_left = more & (rx > ry)
            undo_right = more & ~undo_left
            # Equal merges happen from left to right: after undoing the right one, the same merge on its left comes first.
            limit[at[undo_left]] = rx[undo_left]
            limit[at[undo_right]] = ry[undo_right] + 1
            a[at[undo_left]] = self.right[x[undo_left]]
            b[at[undo_right]] = self.left[y[undo_right]]
            at = at[more]
        return good

    def propose(self, word: bytes) -> list[int] | None:
        """Greedy longest match."""
        out, i, n = [], 0, len(word)
        final, inner, longest = self.final, self.inner, self.longest
        while True:
            t = final.get(word[i:]) if n - i <= longest + 8 else None
            if t is not None:
                out.append(t)
                return out
            for j in range(min(n - 1, i + longest), i, -1):
                t = inner.get(word[i:j])
                if t is not None:
                    out.append(t)
                    i = j
                    break
            else:
                return None

    def exact(self, word: bytes) -> list[int]:
        """Merge by merge."""
        ids = [self.base[c] for c in word[:-1]] + [self.base_end[word[-1]]]
        merge = self.merge
        if len(ids) > 40:
            return self._exact_long(ids)
        none = len(self.rank)
        pairs = [merge.get(p, (none, 0)) for p in zip(ids, ids[1:])]
        while pairs:
            best = min(pairs)
            if best[0] == none:
                break
            at = pairs.index(best)
            ids[at : at + 2] = [best[1]]
            del pairs[at]
            if at:
                pairs[at - 1] = merge.get((ids[at - 1], ids[at]), (none, 0))
            if at < len(pairs):
                pairs[at] = merge.get((ids[at], ids[at + 1]), (none, 0))
        return ids

    def _exact_long(self, ids: list[int]) -> list[int]:
        n = len(ids)
        after, before, merge = list(range(1, n + 1)), list(range(-1, n - 1)), self.merge
        heap = [(m[0], i, ids[i], ids[i + 1], m[1]) for i in range(n - 1) if (m := merge.get((ids[i], ids[i + 1])))]
        heapq.heapify(heap)
        while heap:
            _, i, x, y, t = heapq.heappop(heap)
            j = after[i]
            if ids[i] != x or j >= n or ids[j] != y:
                continue
            ids[i], ids[j] = t, -1
            after[i] = after[j]
            if after[j] < n:
                before[after[j]] = i
            for p, q in ((before[i], i), (i, after[i])):
                if p >= 0 and q < n and (m := merge.get((ids[p], ids[q]))):
                    heapq.heappush(heap, (m[0], p, ids[p], ids[q], m[1]))
        return [t for t in ids if t >= 0]

    def learn(self, words: Iterable[str]) -> tuple[int, int]:
        """Encodes words into ``known``; gives the words proposed and those merged exactly."""
        words = list(words)
        raw = [w.encode() for w in words]
        tokens = [self.propose(w) for w in raw]
        lengths = np.fromiter((len(t) if t else 0 for t in tokens), np.int64, len(tokens))
        flat = np.fromiter((i for t in tokens if t for i in t), np.int64, int(lengths.sum()))
        failed = lengths == 0
        if len(flat) > 1:
            owner = np.repeat(np.arange(len(tokens)), lengths)
            inside = owner[1:] == owner[:-1]
            keys, where = np.unique(flat[:-1][inside] * self.size + flat[1:][inside], return_inverse=True)
            good = self.compatible(keys // self.size, keys % self.size)
            failed[owner[1:][inside][~good[where]]] = True
        for k in np.flatnonzero(failed):
            tokens[k] = self.exact(raw[k])
        name = self.token
        for w, t in zip(words, tokens, strict=True):
            self.known[w] = (np.array(t, "<u4").tobytes(), " ".join([name[i] for i in t]), len(t))
        return len(words), int(failed.sum())

    def pieces(self, text: str) -> list[list[str]]:
        """Words of the text, with the special tokens' strings in lists of their own."""
        out = []
        for k, part in enumerate(self.special_pattern.split(text)):
            if k % 2:
                out.append([part])
            elif SETTLED.search(part):
                found = self.library.pre_tokenizer.pre_tokenize_str(self.library.normalizer.normalize_str(part))
                out.append([bytes(self.back[c] for c in w).decode() for w, _ in found])
            elif part:
                out.append(self.pattern.findall(unicodedata.normalize("NFC", part).replace("Σ", "σ").lower()))
            else:
                out.append([])
        return out

    def encode(self, texts: list[str]) -> list[tuple[int, bytes, str]]:
        """For each text the number of its ids, the ids as little-endian 32-bit integers, and the decoded text."""
        split = [self.pieces(t) for t in texts]
        if len(self.known) > WORDS_KEPT:
            self.known = {}
        fresh = set()
        for parts in split:
            for words in parts[::2]:
                fresh.update(words)
        self.learn(fresh.difference(self.known))
        special = {t: (np.array([i], "<u4").tobytes(), t, 1) for t, i in self.special.items()}
        out = []
        for parts in split:
            found = [(self.known if k % 2 == 0 else special)[w] for k, words in enumerate(parts) for w in words]
            out.append((sum(f[2] for f in found), b"".join([f[0] for f in found]), " ".join([f[1] for f in found])))
        return out


def slices(texts: list[str]) -> Iterator[tuple[int, int]]:
    """Ranges of about CHARS_AT_ONCE characters."""
    start = held = 0
    for k, t in enumerate(texts):
        held += len(t)
        if held >= CHARS_AT_ONCE:
            yield start, k + 1
            start, held = k + 1, 0
    if start < len(texts):
        yield start, len(texts)


def encode_texts(df: DataFrame, path: str, id_column: str = "doc_id", text: str = "text", with_ids: bool = False) -> DataFrame:
    """Per row: the id, ``n_tokens``, ``ids_sha256`` and ``decoded_sha256``; with_ids adds ``ids`` (binary) and ``decoded``."""
    kind = df.schema[id_column].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = WordBpe(path)
        for batch in (w.slice(k, ROWS_AT_ONCE) for w in batches for k in range(0, w.num_rows, ROWS_AT_ONCE)):
            texts = [t or "" for t in batch.column(1).to_pylist()]
            for a, b in slices(texts):
                rows = bpe.encode(texts[a:b])
                cols = [
                    batch.column(0)[a:b],
                    pa.array([n for n, _, _ in rows], pa.int64()),
                    pa.array([hashlib.sha256(i).hexdigest() for _, i, _ in rows], pa.string()),
                    pa.array([hashlib.sha256(d.encode()).hexdigest() for _, _, d in rows], pa.string()),
                ]
                names = [id_column, "n_tokens", "ids_sha256", "decoded_sha256"]
                if with_ids:
                    cols += [pa.array([i for _, i, _ in rows], pa.binary()), pa.array([d for _, _, d in rows], pa.string())]
                    names += ["ids", "decoded"]
                yield pa.RecordBatch.from_arrays(cols, names)

    more = ", ids binary, decoded string" if with_ids else ""
    return df.select(id_column, text).mapInArrow(run, f"`{id_column}` {kind}, n_tokens bigint, ids_sha256 string, decoded_sha256 string{more}")
