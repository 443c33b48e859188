"""Exact ids of whole texts through a bounded memo of their pieces.

Both tokenizers cut a text into words before any merge, and no word reaches
across the places used here, so the ids of a text are those of its pieces put
together. A piece that repeats is encoded once: plain words by the merges of the tokenizer's file, others by the
tokenizers library.
"""

from __future__ import annotations

import os
import re

import numpy as np

from ._bpe import Bpe

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")

MARK = b"<|endoftext|>"
#: Bytes of white space other than the space and newline, and first bytes of such characters.
_RARE = b"\t\r\x0b\x0c\x1c\x1d\x1e\x1f\xc2\xe1\xe2\xe3"
#: White space (as any tokenizer could see it) with a space after it.
_RUN = re.compile(
    rb"(?:[\t-\r\x1c-\x20]|\xc2[\x85\xa0]|\xe1\x9a\x80|\xe2\x80[\x80-\x8a\xa8\xa9\xaf]|\xe2\x81\x9f|\xe3\x80\x80)(?= )"
)
#: A run of Latin letters, then a run of plain punctuation: two units of either tokenizer.
_PLAIN = re.compile(rb"((?:[A-Za-z]|\xc3[\x80-\x96\x98-\xb6\xb8-\xbf])+)([.,;:!?|]*)\Z")
#: The runs that either tokenizer splits such texts into: letters, digits, other printable ASCII but the apostrophe, one newline inside.
_RUNS = re.compile(rb"(?:[A-Za-z]|\xc3[\x80-\x96\x98-\xb6\xb8-\xbf])+|[0-9]+|[!-&(-/:-@[-`{-~]+|(?<=[!-~\x80-\xbf])\n(?=[!-~\xc3])")
_WHITE = re.compile(_RUN.pattern[: -len(b"(?= )")] + rb"\Z")


class Memo:
    """piece -> its ids as little-endian uint32 bytes; holds at most 2 * keep pieces."""

    def __init__(self, path: str, before: bytes = b"", keep: int = 500_000, longest: int = 48):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.bpe, self.lower = Bpe(path), bool(self.tokenizer.normalizer)
        self.mark = self.tokenizer.token_to_id(MARK.decode())
        self.before, self.keep, self.longest = before, keep, longest
        self.new: dict[bytes, bytes] = {}
        self.old: dict[bytes, bytes] = {}

    def raw(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def learn(self, pieces: set[bytes]) -> None:
        """Make every piece known, encoding the unknown ones in one call."""
        missing = {p for p in pieces if p not in self.new}
        if not missing:
            return
        if len(self.new) + len(missing) > self.keep:
            self.old, self.new = self.new, {}
            missing = set(pieces)
        if self.old:
            known = {p: self.old[p] for p in missing if p in self.old}
            self.new.update(known)
            missing.difference_update(known)
        found = [(p, m) for p in missing if len(p) <= self.longest and (m := _PLAIN.match(p))]
        self._plain(found)
        missing.difference_update(p for p, _ in found)
        self._mixed([(p, r) for p in missing if 0 < len(p) <= self.longest and b"<|" not in p and b"|>" not in p and sum(map(len, r := _RUNS.findall(p))) == len(p)])
        missing = {p for p in missing if p not in self.new}
        odd = {p for p in missing if b"<|" in p or b"|>" in p or len(p) > self.longest}
        for p in odd:
            self.new[p] = self.raw((self.before + p).decode())
        rest = list(missing - odd)
        if rest:
            joined = MARK.join(self.before + p for p in rest).decode()
            ids = np.array(self.tokenizer.encode_batch_fast([joined], add_special_tokens=False)[0].ids, "<u4")
            ends = np.append(np.flatnonzero(ids == self.mark), len(ids)).tolist()
            data, start = ids.tobytes(), 0
            for p, end in zip(rest, ends, strict=True):
                self.new[p] = data[4 * start : 4 * end]
                start = end + 1

    def _plain(self, found: list[tuple[bytes, re.Match]]) -> None:
        """Pieces of letters and then punctuation, by the tokenizer's own merges."""
        words = [m[1] for _, m in found]
        if self.lower and words:
            words = b"\n".join(words).decode().lower().encode().split(b"\n")
        units = list({self.before + w for w, (_, m) in zip(words, found, strict=True)} | {m[2] for _, m in found} - {b""})
        ids = dict(zip(units, self.bpe.encode(units), strict=True)) | {b"": b""}
        for w, (p, m) in zip(words, found, strict=True):
            self.new[p] = ids[self.before + w] + ids[m[2]]


    def _mixed(self, found: list[tuple[bytes, list[bytes]]]) -> None:
        """Pieces of several runs; digits are words of their own where white space is dropped."""
        if self.lower:
            found = [(p, [x for r in b"\n".join(runs).decode().lower().encode().split(b"\n") for x in ([r[i : i + 1] for i in range(len(r))] if r.isdigit() else [r])]) for p, runs in found]
        found = [(p, [self.before + runs[0], *runs[1:]]) for p, runs in found]
        units = list({u for _, runs in found for u in runs})
        get = dict(zip(units, self.bpe.encode(units), strict=True)).__getitem__
        for p, runs in found:
            self.new[p] = b"".join(map(get, runs))


class Words(Memo):
    """For tokenizers that drop white space: pieces are runs without ASCII white space."""

    def encode(self, texts: list[bytes]) -> list[bytes]:
        words = [t.split() for t in texts]
        self.learn(set().union(*words))
        get = self.new.__getitem__
        return [b"".join(map(get, w)) for w in words]


class Spaced(Memo):
    """For byte-level tokenizers: pieces begin with a space that follows a character other than white space."""

    def __init__(self, path: str, **more):
        super().__init__(path, before=b" ", **more)

    @staticmethod
    def pieces(text: bytes) -> list[bytes]:
        """The first piece, then the others without the space they begin with."""
        parts = text.split(b" ")
        plain = len(text.translate(None, _RARE)) == len(text) and b"  " not in text and b"\n " not in text
        if plain or not _RUN.search(text):
            return parts
        out = [parts[0]]
        for p in parts[1:]:
            before = out[-1] if len(out) == 1 else b" " + out[-1]
            if _WHITE.search(before):
                out[-1] += b" " + p
            else:
                out.append(p)
        return out

    def encode(self, texts: list[bytes]) -> list[bytes]:
        cut = [self.pieces(t) for t in texts]
        self.learn(set().union(*(c[1:] for c in cut)))
        get = self.new.__getitem__
        return [(self.raw(c[0].decode()) if c[0] else b"") + b"".join(map(get, c[1:])) for c in cut]
