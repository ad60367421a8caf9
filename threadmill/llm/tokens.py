"""Whole-text encoding with a public tokenizer file, sped up by remembering pieces between white space.

Both vocabularies split text before they merge, and no split unit crosses from
a visible character into white space.  So a text may be cut in front of white
space, its pieces encoded apart, and the ids joined: the result equals encoding
the whole text.  Pieces repeat, so each worker keeps the ids of those it has seen
(up to ``CACHE_PIECES``; then it starts anew).  Texts with unusual white space, or
runs of it where position matters, go to the tokenizer whole; so do texts that hold one of
the vocabulary's added tokens, which the tokenizer finds before it splits.
"""

from __future__ import annotations

import os

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")

from itertools import islice

import numpy as np

#: Entries of a worker's memory of pieces.
CACHE_PIECES = 2_400_000
#: Pieces encoded in one call.
CHUNK = 64
#: Marks after letters that are a unit of their own (an apostrophe may begin a contraction, so it isn't one).
MARKS = ".,;:!?#$%&*|"
#: White space in Python's sense alone, or a line break of its own kind: such texts are encoded whole.
ODD_SPACE = "\x1c\x1d\x1e\x1f\x85"


def tokenizer_json(path: str) -> str:
    """The tokenizer file's content; it is small (a few MB), so tasks carry it instead of a path that only the driver may have."""
    with open(path, encoding="utf-8") as f:
        return f.read()


class Encoder:
    """ids of whole texts, as little-endian unsigned 32-bit integers."""

    def __init__(self, spec: str) -> None:
        import json

        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(spec)
        content = json.loads(spec)
        model = content["model"]
        #: Added tokens, in lower case: a normalizer may fold a text's letters before they are looked for.
        self.added = [a["content"].lower() for a in content.get("added_tokens") or []]
        self.word_ends = model.get("end_of_word_suffix") or ""
        size = self.tokenizer.get_vocab_size(True)
        self.vocabulary = size
        flags = {"space": np.zeros(size, bool), "line": np.zeros(size, bool), "end": np.zeros(size, bool)}
        for token, i in self.tokenizer.get_vocab(True).items():
            flags["space"][i] = token.startswith("Ġ")
            flags["line"][i] = token.startswith("Ċ")
            flags["end"][i] = bool(self.word_ends) and token.endswith(self.word_ends)
        self.flags = flags
        self.known: dict[str, bytes] = {}

    def _ids(self, text: str) -> np.ndarray:
        # the batch call that leaves out offsets, with one text
        return np.asarray(self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids, "<u4")

    def whole(self, text: str) -> bytes:
        return self._ids(text).tobytes()

    def _holds_added(self, text: str) -> bool:
        low = text.lower()
        return any(a in low for a in self.added)

    def _chunks(self, pieces: list[str], text, flag: str, at_start: bool, into: dict[str, bytes], key) -> None:
        """Encode many pieces by few calls; where a unit begins (or ends) shows by its tokens."""
        it = iter(pieces)
        mark = self.flags[flag]
        while chunk := list(islice(it, CHUNK)):
            ids = self._ids(text(chunk))
            at = np.flatnonzero(mark[ids])
            if len(at) != len(chunk):
                for p in chunk:
                    into[key(p)] = self.whole(text([p]))
                continue
            cuts = (np.append(at, len(ids)) if at_start else np.append(0, at + 1)) * 4
            raw = ids.tobytes()
            for p, a, b in zip(chunk, cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
                into[key(p)] = raw[a:b]

    def _learn(self, missing: list[str]) -> None:
        if len(self.known) + len(missing) > CACHE_PIECES:
            self.known.clear()
        if self.word_ends:
            self._learn_words(missing)
        else:
            self._learn_bytes(missing)

    def _learn_bytes(self, missing: list[str]) -> None:
        """Letters (with what precedes them) are one unit and the marks after them another, so each is encoded once."""
        known, parts, need = self.known, [], set()
        for p in missing:
            if p[0] == "\0":
                known[p] = self.whole(p[1:])
                continue
            stem = p.rstrip(MARKS)
            bare = stem[1:] if p[0] == "\n" else stem
            if len(stem) < len(p) and bare.isalpha() and (bare.isascii() or max(bare) < "ƀ"):
                parts.append((p, stem, "\2" + p[len(stem) :]))
                if stem not in known:
                    need.add(stem)
            else:
                need.add(p)
        self._chunks([p for p in need if p[0] != "\n"], lambda c: " " + " ".join(c), "space", True, known, lambda p: p)
        self._chunks([p for p in need if p[0] == "\n"], "".join, "line", True, known, lambda p: p)
        for p, stem, tail in parts:
            if tail not in known:
                known[tail] = self.whole(tail[1:])
            known[p] = known[stem] + known[tail]

    def _learn_words(self, missing: list[str]) -> None:
        """A run of letters followed by marks is the letters' unit, then the marks'; letters are remembered in lower case."""
        stems: dict[str, tuple[str, str]] = {}
        for p in missing:
            stem = p.rstrip(MARKS)
            if stem and stem.isalpha() and (stem.isascii() or max(stem) < "ƀ"):
                stems[p] = (stem.lower(), p[len(stem) :])
            else:
                self.known[p] = self.whole(p)
        new = list({"\1" + s for s, _ in stems.values()}.difference(self.known))
        self._chunks([x[1:] for x in new], " ".join, "end", False, self.known, lambda s: "\1" + s)
        tails = {"\2" + t for _, t in stems.values() if t}.difference(self.known)
        for t in tails:
            self.known[t] = self.whole(t[1:])
        for p, (s, t) in stems.items():
            self.known[p] = self.known["\1" + s] + (self.known["\2" + t] if t else b"")

    def _pieces(self, text: str) -> list[str] | None:
        """The keys of a text's pieces; None where only the whole text will do."""
        if any(c in text for c in ODD_SPACE) or "\0" in text or "\1" in text or "\2" in text or self._holds_added(text):
            return None
        pieces = text.split()
        if self.word_ends:
            return pieces
        if not pieces or " ".join(pieces) != text.replace("\n", " "):
            return None
        if "\n" in text:
            pieces = text.replace("\n", " \n").split(" ")
        pieces[0] = "\0" + pieces[0]
        return pieces

    def encode(self, texts: list[str]) -> list[bytes]:
        keys = [self._pieces(t) for t in texts]
        known = self.known
        missing = set().union(*(k for k in keys if k)).difference(known)
        if missing:
            self._learn(list(missing))
            known = self.known
        out = []
        for t, k in zip(texts, keys, strict=True):
            if k is None:
                out.append(self.whole(t))
                continue
            try:
                out.append(b"".join(map(known.__getitem__, k)))
            except KeyError:  # the memory was emptied meanwhile
                self._learn(list(set(k).difference(known)))
                out.append(b"".join(map(known.__getitem__, k)))
        return out


_encoders: dict[int, Encoder] = {}


def encoder(spec: str) -> Encoder:
    """One encoder per worker process and tokenizer: its memory outlasts the task."""
    key = hash(spec)
    if key not in _encoders:
        _encoders[key] = Encoder(spec)
    return _encoders[key]


def text_chunks(texts: list[str | None], most: int = 2 << 20):
    """(first, texts) slices of about ``most`` characters; a longer text stands alone. None becomes ''."""
    first, size, part = 0, 0, []
    for i, t in enumerate(texts):
        t = t or ""
        if part and size + len(t) > most:
            yield first, part
            first, size, part = i, 0, []
        part.append(t)
        size += len(t)
    if part:
        yield first, part
