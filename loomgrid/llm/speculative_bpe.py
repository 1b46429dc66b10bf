"""Operator 7, BPE encoding and decoding by speculation.

For every distinct word a greedy longest match proposes tokens.  A proposal is
the byte-pair encoding exactly if no merge ever crosses a border between two
adjacent tokens, so one vectorised check over all distinct adjacent pairs of a
batch decides all words at once; only words with an incompatible pair are
merged step by step.

Null texts count as empty: no ids, decoded to the empty string.  Texts are
encoded whole, whatever their length; special tokens' strings are recognised
as the library does.  Repeated rows give repeated results, an empty table an
empty one, and extra columns are not read.
"""

from __future__ import annotations

import json
import re
from functools import lru_cache
from heapq import heapify, heappop, heappush

import numpy as np

from loomgrid.llm import tokens

NEVER = np.iinfo(np.int64).max


class SpeculativeBpe:
    """A byte-pair model read from a tokenizer file."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        self.end = model.get("end_of_word_suffix") or ""
        self.lower = spec["normalizer"] is not None
        self.ids: dict[str, int] = model["vocab"]
        self.names = {i: t for t, i in self.ids.items()} | {a["id"]: a["content"] for a in spec["added_tokens"]}
        self.special = {a["content"]: a["id"] for a in spec["added_tokens"]}
        self.special_re = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self.library = Tokenizer.from_file(path)
        self.has_decoder = self.library.decoder is not None
        self.byte_chars = tokens.byte_chars()
        self.rank: dict[tuple[str, str], int] = {tuple(m.split(" ")) if isinstance(m, str) else tuple(m): r for r, m in enumerate(model["merges"])}
        self._index()
        self.words: dict[str, tuple[bytes, str]] = {}

    def _index(self) -> None:
        """Spines of every token that its own symbols merge to, and the ranks of all merges."""
        made = {a + b: (a, b, r) for (a, b), r in reversed(self.rank.items())}
        self.reachable: set[str] = set()
        self.monotone = True
        right, left = {}, {}
        for token in sorted(self.ids, key=len):
            if token not in made:
                # a symbol of its own, unless its length shows that only merges could make it
                if len(token.removesuffix(self.end)) <= 1 or token == self.end:
                    self.reachable.add(token)
                    right[token] = left[token] = [(self.ids[token], -1)]
                continue
            if self.merge(token.removesuffix(self.end), self.end if token.endswith(self.end) else "") != [token]:
                continue
            a, b, r = made[token]
            self.reachable.add(token)
            right[token] = [*right[b], (self.ids[token], r)]
            left[token] = [*left[a], (self.ids[token], r)]
            self.monotone &= right[b][-1][1] < r and left[a][-1][1] < r
        n = max(self.ids.values()) + 1
        self.spine = {}
        for side, spines in (("right", right), ("left", left)):
            width = max(map(len, spines.values()))
            who = np.full((n, width), -1, np.int64)
            when = np.full((n, width + 1), NEVER, np.int64)
            for token, steps in spines.items():
                k = self.ids[token]
                who[k, : len(steps)] = [s[0] for s in steps]
                when[k, : len(steps)] = [s[1] for s in steps]
            self.spine[side] = (who, when)
        keys = np.array([(self.ids[a] << 32) | self.ids[b] for a, b in self.rank if a in self.ids and b in self.ids], np.int64)
        ranks = np.array([r for (a, b), r in self.rank.items() if a in self.ids and b in self.ids], np.int64)
        order = np.argsort(keys)
        self.merge_keys, self.merge_ranks = keys[order], ranks[order]
        self.longest = max(len(t.removesuffix(self.end)) for t in self.reachable)

    def compatible(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """For each pair of token ids: no merge crosses the border between them.

        The symbol left of the border climbs the right spine of ``a``, the one
        right of it the left spine of ``b``, each at the rank of its merge.  A
        crossing merge needs a rank below the left neighbour's next step, and
        not above the right one's, since equal ranks merge from the left.
        """
        right, right_at = self.spine["right"]
        left, left_at = self.spine["left"]
        good = np.ones(len(a), bool)
        live = np.arange(len(a))
        i = np.zeros(len(a), np.int64)
        j = np.zeros(len(a), np.int64)
        while len(live):
            p, q = i[live], j[live]
            x, y = a[live], b[live]
            key = (right[x, p] << 32) | left[y, q]
            at = np.minimum(np.searchsorted(self.merge_keys, key), len(self.merge_keys) - 1)
            rank = np.where(self.merge_keys[at] == key, self.merge_ranks[at], NEVER)
            up, down = right_at[x, p + 1], left_at[y, q + 1]
            crossed = (rank != NEVER) & (rank < up) & (rank <= down)
            good[live[crossed]] = False
            done = crossed | ((up == NEVER) & (down == NEVER))
            first = up <= down
            i[live[first & ~done]] += 1
            j[live[~first & ~done]] += 1
            live = live[~done]
        return good

    def propose(self, word: str) -> list[int] | None:
        """Greedy longest match of reachable tokens; None if some symbol has no token."""
        out, at, n, ids, ok = [], 0, len(word), self.ids, self.reachable
        while at < n:
            stop = min(n, at + self.longest)
            while stop > at:
                token = word[at:stop] + self.end if stop == n else word[at:stop]
                if token in ok:
                    break
                stop -= 1
            else:
                return None
            out.append(ids[token])
            at = stop
        return out

    def merge(self, word: str, end: str | None = None) -> list[str]:
        """Exact merging: always the leftmost pair of the lowest rank, from a heap of the pairs of a linked list."""
        parts = list(word)
        if parts:
            parts[-1] += self.end if end is None else end
        rank, n = self.rank, len(parts)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(r, i, pair) for i, pair in enumerate(zip(parts, parts[1:])) if (r := rank.get(pair)) is not None]
        heapify(heap)
        while heap:
            _, i, pair = heappop(heap)
            j = after[i] if parts[i] is not None else n
            if j == n or (parts[i], parts[j]) != pair:
                continue  # merged since
            parts[i], parts[j] = pair[0] + pair[1], None
            k = after[i] = after[j]
            if k < n:
                before[k] = i
                if (r := rank.get((parts[i], parts[k]))) is not None:
                    heappush(heap, (r, i, (parts[i], parts[k])))
            if (k := before[i]) >= 0 and (r := rank.get((parts[k], parts[i]))) is not None:
                heappush(heap, (r, k, (parts[k], parts[i])))
        return [x for x in parts if x is not None]

    def learn(self, words: list[str]) -> int:
        """Encode distinct words (byte-level strings) into the cache; the number merged exactly."""
        proposed = [self.propose(w) for w in words]
        sizes = np.array([len(p) if p else 0 for p in proposed], np.int64)
        flat = np.array([t for p in proposed if p for t in p], np.int64)
        owner = np.repeat(np.arange(len(words)), sizes)
        bad = np.array([p is None for p in proposed], bool) if self.monotone else np.ones(len(words), bool)
        inner = owner[1:] == owner[:-1]
        pairs = (flat[:-1][inner] << 32) | flat[1:][inner]
        seen, back = np.unique(pairs, return_inverse=True)
        good = self.compatible(seen >> 32, seen & 0xFFFFFFFF)
        bad[owner[1:][inner][~good[back]]] = True
        for k, word in enumerate(words):
            ids = [self.ids[t] for t in self.merge(word) if t in self.ids] if bad[k] else proposed[k]
            self.words[word] = (np.array(ids, dtype="<u4").tobytes(), " ".join([self.names[t] for t in ids]))
        return int(bad.sum())

    def split(self, text: str) -> list[str]:
        """Byte-level words; special tokens stand as they are and are kept apart by a leading NUL."""
        if (plain := tokens.split_words(text, self.lower)) is not None:
            return plain
        out: list[str] = []
        for k, part in enumerate(self.special_re.split(text) if self.special_re else [text]):
            if k % 2:
                out.append("\0" + part)
            elif part:
                normal = self.library.normalizer.normalize_str(part) if self.library.normalizer else part
                out += ["\1" + w for w, _ in self.library.pre_tokenizer.pre_tokenize_str(normal)]
        return out

    def _byte_level(self, word: str) -> str:
        if word[0] == "\1":
            return word[1:]
        return "".join([self.byte_chars[x] for x in word.encode()])

    def encode(self, texts: list[str]) -> list[tuple[bytes, str]]:
        """(ids as little-endian unsigned 32-bit integers, decoded text) of each text."""
        split = [self.split(t) for t in texts]
        if len(self.words) > tokens.CACHE_WORDS:
            self.words.clear()
        new = [w for w in set().union(*split) - self.words.keys()]
        for w in new:
            if w[0] == "\0":
                k = self.special[w[1:]]
                self.words[w] = (k.to_bytes(4, "little"), self.names[k])
        new = [w for w in new if w[0] != "\0"]
        spelt = [self._byte_level(w) for w in new]
        fresh = list(dict.fromkeys(spelt))
        held = {s: self.words[s] for s in fresh if s in self.words}  # a plain word may be spelt like its bytes
        self.learn(fresh)
        made = [self.words[s] for s in spelt]
        for s in fresh:
            if s in held:
                self.words[s] = held[s]
            else:
                del self.words[s]
        self.words.update(zip(new, made, strict=True))
        out = []
        for ws in split:
            found = [self.words[w] for w in ws]
            ids = b"".join([f[0] for f in found])
            out.append((ids, self.library.decode(np.frombuffer(ids, "<u4").tolist(), skip_special_tokens=False) if self.has_decoder else " ".join([f[1] for f in found if f[1]])))
        return out


@lru_cache(4)
def model(path: str) -> SpeculativeBpe:
    """One model per worker and tokenizer file."""
    return SpeculativeBpe(path)


def encode_decode(docs, path: str, key: str = "doc_id", text: str = "text"):
    """DataFrame of (key, ids binary, decoded string), one row per row of ``docs``."""
    import pyarrow as pa
    from pyspark.sql import types as T

    def run(batches):
        bpe = model(path)
        for rows in tokens.slices(tokens.batch_rows(batches)):
            done = bpe.encode([t for _, t in rows])
            yield pa.RecordBatch.from_arrays(
                [pa.array([k for k, _ in rows], kind), pa.array([d[0] for d in done], pa.binary()), pa.array([d[1] for d in done], pa.string())],
                names=[key, "ids", "decoded"],
            )

    from pyspark.sql.pandas.types import to_arrow_type

    field = docs.schema[key]
    kind = to_arrow_type(field.dataType)
    schema = T.StructType([T.StructField(key, field.dataType), T.StructField("ids", T.BinaryType()), T.StructField("decoded", T.StringType())])
    return docs.select(key, text).mapInArrow(run, schema)
