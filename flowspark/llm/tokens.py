"""Byte-level BPE ids of many texts at once.

The pre-tokeniser's pattern is applied to whole batches with array operations, and each distinct
piece is merged once and remembered. Texts that hold a special token's string, or pieces longer
than LONGEST, go through the `tokenizers` library itself; the ids are those of that library.
"""

from __future__ import annotations

import base64
import unicodedata

import numpy as np

#: Code points per array pass, and pieces remembered between passes.
CHUNK = 1 << 19
REMEMBERED = 300_000
LONGEST = 256

_LETTER, _NUMBER, _SPACE, _OTHER, _END = range(5)
_SEP = "\U0010ffff"


def _classes() -> np.ndarray:
    """Letter, number, white space or other, for every code point."""
    kind = {"L": _LETTER, "N": _NUMBER}
    table = np.fromiter((kind.get(unicodedata.category(chr(c))[0], _OTHER) for c in range(0x110000)), np.uint8, 0x110000)
    table[[*range(9, 14), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]] = _SPACE
    table[ord(_SEP)] = _END
    return table


class Encoder:
    """ids of texts, as the tokenizer file at `json_path` gives them without special tokens added."""

    def __init__(self, json_path: str):
        import tiktoken
        from tokenizers import Tokenizer

        self.slow = Tokenizer.from_file(json_path)
        self.special = [t.content for t in self.slow.get_added_tokens_decoder().values()]
        with open(json_path.removesuffix(".json") + ".tiktoken", "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.merge = tiktoken.Encoding("ranks", pat_str=r"[\s\S]+", mergeable_ranks=ranks, special_tokens={})._core_bpe.encode_single_piece
        self.classes = _classes()
        rng = np.random.default_rng(7)
        self.code = rng.integers(1, 2**63, 0x110000, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        base = 0x9E3779B97F4A7C15
        inverse = pow(base, -1, 2**64)
        self.powers = np.cumprod(np.concatenate([[np.uint64(1)], np.full(CHUNK, base, np.uint64)]), dtype=np.uint64)
        self.inverses = np.cumprod(np.concatenate([[np.uint64(1)], np.full(CHUNK, inverse, np.uint64)]), dtype=np.uint64)
        self._forget()

    def _forget(self) -> None:
        self.slots: dict[int, int] = {}
        self.n = self.used = 0
        self.off, self.cnt = np.zeros(1024, np.int64), np.zeros(1024, np.int64)
        self.flat = np.zeros(4096, np.uint32)

    def _remember(self, ids: list[int]) -> int:
        if self.n == len(self.off):
            self.off, self.cnt = np.resize(self.off, 2 * self.n), np.resize(self.cnt, 2 * self.n)
        while self.used + len(ids) > len(self.flat):
            self.flat = np.resize(self.flat, 2 * len(self.flat))
        self.off[self.n], self.cnt[self.n] = self.used, len(ids)
        self.flat[self.used : self.used + len(ids)] = ids
        self.used += len(ids)
        self.n += 1
        return self.n - 1

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """One array of ids per text."""
        out: list[np.ndarray | None] = [None] * len(texts)
        group, size = [], 0
        for i, text in enumerate(texts):
            if len(text) >= CHUNK // 2 or _SEP in text or any(s in text for s in self.special):
                out[i] = np.array(self.slow.encode(text, add_special_tokens=False).ids, np.uint32)
                continue
            if size + len(text) + 1 > CHUNK:
                self._group(texts, group, out)
                group, size = [], 0
            group.append(i)
            size += len(text) + 1
        self._group(texts, group, out)
        return out

    def _group(self, texts: list[str], group: list[int], out: list) -> None:
        if not group:
            return
        joined = _SEP.join(texts[i] for i in group) + _SEP
        cp = np.frombuffer(joined.encode("utf-32-le"), np.uint32)
        starts = self.starts(cp)
        ends = np.append(starts[1:], len(cp))
        with np.errstate(over="ignore"):
            sums = np.concatenate([[np.uint64(0)], np.cumsum(self.code[cp] * self.powers[: len(cp)], dtype=np.uint64)])
            hashes = (sums[ends] - sums[starts]) * self.inverses[starts]
        is_end = cp[starts] == ord(_SEP)
        doc_of = np.cumsum(is_end) - is_end
        real = ~is_end
        starts, ends, hashes, doc_of = starts[real], ends[real], hashes[real], doc_of[real]
        long = ends - starts > LONGEST
        if long.any():
            odd = np.unique(doc_of[long])
            for d in odd:
                out[group[d]] = np.array(self.slow.encode(texts[group[d]], add_special_tokens=False).ids, np.uint32)
            stay = ~np.isin(doc_of, odd)
            starts, ends, hashes, doc_of = starts[stay], ends[stay], hashes[stay], doc_of[stay]
        distinct, first, inverse = np.unique(hashes, return_index=True, return_inverse=True)
        slots = [self.slots.get(h, -1) for h in distinct.tolist()]
        kept_n, kept_used, full = self.n, self.used, len(self.slots) >= REMEMBERED
        for j in [j for j, s in enumerate(slots) if s < 0]:
            at = first[j]
            slots[j] = self._remember(self.merge(joined[starts[at] : ends[at]].encode()))
            if not full:
                self.slots[int(distinct[j])] = slots[j]
        of = np.array(slots, np.int64)[inverse]
        counts = self.cnt[of]
        before = np.cumsum(counts) - counts
        total = int(counts.sum())
        ids = self.flat[np.repeat(self.off[of] - before, counts) + np.arange(total)]
        per_doc = np.bincount(doc_of, weights=counts, minlength=len(group)).astype(np.int64)
        for i, part in zip(group, np.split(ids, np.cumsum(per_doc)[:-1]), strict=True):
            if out[i] is None:
                out[i] = part
        if full:  # what did not fit into the memory is dropped again
            self.n, self.used = kept_n, kept_used

    def starts(self, cp: np.ndarray) -> np.ndarray:
        """Where pieces start: runs of letters, of numbers or of other signs, each with one space
        before it; white space but for that space; and English contractions."""
        cls = self.classes[cp]
        edge = np.ones(len(cp), bool)
        edge[1:] = (cls[1:] != cls[:-1]) | (cls[1:] == _END)
        runs = np.flatnonzero(edge)
        nxt = np.append(runs[1:], len(cp))
        gap = (cls[runs] == _SPACE) & (nxt < len(cp))
        last = nxt[gap] - 1
        followed = cls[last + 1] != _END
        last = last[followed]
        edge[last] = True
        edge[last[cp[last] == 0x20] + 1] = False
        quote = np.flatnonzero(cp == 0x27)
        if len(quote):
            quote = quote[quote + 1 < len(cp)]
            prev = np.where(quote > 0, cls[quote - 1], _END)
            ok = (prev != _OTHER) & (cls[quote + 1] == _LETTER) & ~((quote > 0) & (cp[quote - 1] == 0x20))
            quote = quote[ok]
            a = cp[quote + 1]
            b = cp[np.minimum(quote + 2, len(cp) - 1)]
            one = np.isin(a, [ord(c) for c in "stmd"])
            two = ((a == ord("r")) & (b == ord("e"))) | ((a == ord("v")) & (b == ord("e"))) | ((a == ord("l")) & (b == ord("l")))
            edge[quote[one | two] + 1] = False
            edge[quote[one] + 2] = True
            edge[quote[two] + 3] = True
        return np.flatnonzero(edge)
