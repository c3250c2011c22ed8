"""Fast, exact encoding with the tokenizers library: pieces seen before come from a bounded cache."""

from __future__ import annotations

import json
import os
import re

import numpy as np

# Letters and digits of the code points up to U+00FF, where all Unicode versions agree.
_L = "A-Za-z\xaa\xb5\xba\xc0-\xd6\xd8-\xf6\xf8-\xff"
_N = "0-9\xb2\xb3\xb9\xbc-\xbe"
_CONTRACTIONS = "'s|'t|'re|'ve|'m|'ll|'d"
#: Latin-1 bytes of other characters: texts with these, or beyond Latin-1, are encoded whole by the library.
_OTHER = bytes(c for c in range(256) if c not in b"\t\n\r" and not 32 <= c < 127 and c < 161)
_BYTE_LEVEL = re.compile(f"{_CONTRACTIONS}| ?[{_L}]+| ?[{_N}]+| ?[^\\s{_L}{_N}]+|\\s+(?!\\S)|\\s+")
#: The same without the look-ahead, which only white space next to white space needs (see ``_loose``).
_SPLITS = {
    "bytes": f" ?[{_L}]+|{_CONTRACTIONS}| ?[{_N}]+| ?[^\\s{_L}{_N}]+|\\s+",
    "words": f" ?[{_L}]+| ?(?:{_CONTRACTIONS})| ?[{_N}]| ?[^\\s{_L}{_N}]+|\\s+",
}
_CACHE_PIECES = 300_000
_JOINED, _AT_ONCE = 128, 128
_loaded: dict[str, Encoder] = {}


def _loose(t: str) -> bool:
    return "  " in t or "\n " in t or " \n" in t or "\n\n" in t or "\t" in t or "\r" in t or t[:1] in " \n" or t[-1:] in " \n"


class Encoder:
    """Ids of whole texts as little-endian unsigned 32-bit bytes.

    Both public vocabularies split a text by a pattern and merge within the pieces only, so a piece always has the same
    ids. Pieces seen lately are kept (two generations of a bounded number); new ones are encoded many at a time and told
    apart by the tokens that begin or end a piece. A file with another pre-tokenizer is used without the cache.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        with open(path) as f:
            made = json.load(f)
        pre, norm = made["pre_tokenizer"] or {}, made["normalizer"] or {}
        # the library finds added tokens before it splits a text, so a text that may hold one goes to it whole
        self.starts = sorted({t["content"].strip()[:2].lower() for t in made["added_tokens"]})
        self.cased = any(s.upper() != s for s in self.starts)
        self.kind = None
        if pre.get("type") == "ByteLevel" and pre.get("use_regex") and not pre.get("add_prefix_space") and not norm:
            self.kind, mark = "bytes", lambda t: t.startswith("Ġ")
        elif [x.get("type") for x in norm.get("normalizers", [])] == ["NFC", "Replace", "Lowercase"]:
            self.kind, mark = "words", lambda t: t.endswith("</w>")
        if self.kind:
            self.split = _SPLITS[self.kind]
            vocab = self.tokenizer.get_vocab()
            self.marks = np.zeros(max(vocab.values()) + 1, bool)
            self.marks[[i for t, i in vocab.items() if mark(t)]] = True
        self.new: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}

    def _special(self, t: str) -> bool:
        """Whether a text isn't all of known characters, or may hold an added token."""
        try:
            plain = t.encode("latin-1")
        except UnicodeEncodeError:
            return True
        if len(plain.translate(None, _OTHER)) < len(plain):
            return True
        t = t.lower() if self.cased else t
        return any(s in t for s in self.starts)

    def _whole(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, "<u4").tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _pieces(self, pieces: list[str]) -> dict[str, bytes]:
        """Ids of distinct pieces. Joined ones come apart at the first token (bytes) or last token (words) of each."""
        if self.kind == "bytes":
            joined = [p for p in pieces if p[0] == " " and p[1:].isalpha()]
            other = list(set(pieces).difference(joined))
        else:
            joined, other = pieces, []
        out = dict(zip(other, self._whole(other)))
        glue = "" if self.kind == "bytes" else " "
        for at in range(0, len(joined), _JOINED * _AT_ONCE):
            runs = [joined[i : i + _JOINED] for i in range(at, min(len(joined), at + _JOINED * _AT_ONCE), _JOINED)]
            for run, e in zip(runs, self.tokenizer.encode_batch_fast([glue.join(r) for r in runs], add_special_tokens=False)):
                ids = np.array(e.ids, "<u4")
                cuts = (4 * np.flatnonzero(self.marks[ids])).tolist()
                cuts = [*cuts, 4 * len(ids)] if self.kind == "bytes" else [0, *[c + 4 for c in cuts]]
                if len(cuts) != len(run) + 1:
                    out.update(zip(run, self._whole(run)))
                    continue
                data = ids.tobytes()
                out.update(zip(run, map(data.__getitem__, map(slice, cuts, cuts[1:]))))
        return out

    def _ids(self, pieces: list[str]) -> list[bytes]:
        """Ids of each piece; new pieces are learned. White space has no ids where the vocabulary drops it."""
        new, old = self.new, self.old
        out = list(map(new.get, pieces))
        at = [i for i, ids in enumerate(out) if ids is None]
        if at:
            rest = {pieces[i] for i in at}
            unknown = rest.difference(old)
            known = {"": b""}
            unknown.difference_update(known)
            known.update(self._pieces(list(unknown)))
            known.update((p, old[p]) for p in rest.intersection(old))
            for i in at:
                out[i] = known[pieces[i]]
            new.update(known)
            if len(new) > _CACHE_PIECES:
                self.old, self.new = new, {}
        return out

    def _gather(self, texts: list[str]) -> list[bytes]:
        """Distinct pieces are looked up once for all texts; Arrow splits the texts and lays out the ids."""
        import pyarrow as pa
        import pyarrow.compute as pc

        marked = pc.replace_substring_regex(pa.array(texts, pa.large_string()), self.split, "\\0\x01")
        lists = pc.split_pattern(marked, "\x01")
        coded = lists.flatten().dictionary_encode()
        words = coded.dictionary.to_pylist()
        if self.kind == "words":
            words = [w.strip() for w in words]
        ids = pa.array(self._ids(words), pa.large_binary()).take(coded.indices)
        _, offsets, data = ids.buffers()
        at = np.frombuffer(offsets, "<i8")[: len(ids) + 1][lists.offsets.to_numpy()].tolist()
        view = memoryview(data) if data else b""
        return [bytes(view[s:e]) for s, e in zip(at, at[1:])]

    def encode(self, texts: list[str]) -> list[bytes]:
        out: list[bytes | None] = [None] * len(texts)
        plain, special = [], [not self.kind or self._special(t) for t in texts]
        if self.kind == "words":
            texts = [t if odd else t.lower() for t, odd in zip(texts, special)]
        for i, t in enumerate(texts):
            if special[i]:
                out[i] = self._whole([t])[0]
            elif self.kind == "bytes" and _loose(t):
                out[i] = b"".join(self._ids(_BYTE_LEVEL.findall(t)))
            else:
                plain.append(i)
        if plain:
            for i, ids in zip(plain, self._gather([texts[i] for i in plain])):
                out[i] = ids
        return out


def encoder(path: str) -> Encoder:
    """One encoder for each file and worker process."""
    if path not in _loaded:
        _loaded[path] = Encoder(path)
    return _loaded[path]


def encode_batches(path: str, texts: list[bytes | None], end: bytes, most: int = 4_000_000):
    """Ids with the end id for each text in turn, about ``most`` bytes of text at a time; null is empty."""
    enc, held, size = encoder(path), [], 0
    for k, text in enumerate(texts):
        held.append(text.decode("utf-8", "replace") if text else "")
        size += len(text or b"")
        if size >= most or k == len(texts) - 1:
            for ids in enc.encode(held):
                yield ids + end
            held, size = [], 0


def encoding(path: str, run):
    """``run`` as a function of Arrow batches that forgets the known pieces when its partition is done or given up."""

    def held(batches):
        try:
            yield from run(batches)
        finally:
            if path in _loaded:
                _loaded[path].new, _loaded[path].old = {}, {}

    return held
