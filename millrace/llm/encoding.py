"""Token ids of whole texts, each distinct piece of text encoded once.

The tokenizers' pre-tokenizers never join what stands on both sides of certain
spaces, so the ids of a text are those of its pieces one after the other. Pieces
repeat far more often than texts; a bounded cache keeps theirs. Where a text gives
no safe place to cut (runs of white space, special strings, an unknown kind of
tokenizer) the library gets the whole text.
"""

from __future__ import annotations

import json
import os
from collections.abc import Iterable

import numpy as np


class _Pieces(dict):
    """Piece -> its ids as bytes (or their count). ``lead`` is what stands before each piece in a text: a space or nothing."""

    def __init__(self, owner: "TextEncoder", lead: str) -> None:
        super().__init__()
        self.owner, self.lead, self.brief = owner, lead, {}

    def __missing__(self, piece: str):
        got = self.brief.get(piece)
        return self.owner.pack(self.owner.library_ids(self.lead + piece)) if got is None else got


class TextEncoder:
    """``ids(texts)`` gives the ids of each text as little-endian uint32 bytes; with ``count_only``, how many there are.

    ``max_pieces`` bounds the cache of a worker; pieces beyond it are kept for one batch of texts.
    """

    def __init__(self, path: str, *, count_only: bool = False, max_pieces: int = 600_000, max_piece: int = 48) -> None:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        self.count_only, self.max_pieces, self.max_piece = count_only, max_pieces, max_piece
        if path.endswith(".model"):
            import sentencepiece

            self.model, self.kind, self.specials = sentencepiece.SentencePieceProcessor(model_file=path), "pieces", []
        else:
            from tokenizers import Tokenizer

            self.model = Tokenizer.from_file(path)
            self.model.no_truncation()
            self.model.no_padding()
            described = json.loads(self.model.to_str())
            self.specials = [x["content"] for x in described.get("added_tokens") or []]
            self.kind = _kind(described)
        #: Ids are below this.
        self.size = self.model.vocab_size() if self.kind == "pieces" else self.model.get_vocab_size(with_added_tokens=True)
        self.nothing = self.pack([])
        self.spaced, self.bare = _Pieces(self, " "), _Pieces(self, "")
        if self.kind == "dropped":
            self.spaced = self.bare
        if self.kind in ("dropped", "leading"):
            self.bare[""] = self.nothing
            self.newline = self.pack(self.library_ids("\n"))
            #: Stands between pieces that are encoded together.
            self.mark = "~" if self.kind == "dropped" else "\n"
            (self.mark_id,) = self.library_ids(self.mark)
            for x in MARKS:
                self.bare[x] = self.pack(self.library_ids(x))
            from tokenizers.pre_tokenizers import ByteLevel

            spell = ByteLevel(add_prefix_space=False, use_regex=False).pre_tokenize_str
            #: How the byte-level model spells letters beyond ASCII, and the space before a word.
            self.spelling = {c: spell(chr(c))[0][0] for c in range(0xA0, 0x100)}
            self.spelt_space = spell(" ")[0][0]

    def library_ids(self, text: str) -> list[int]:
        if self.kind == "pieces":
            return self.model.encode(text)
        return self.model.encode_batch_fast([text], add_special_tokens=False)[0].ids

    def pack(self, ids: Iterable[int]):
        return len(ids) if self.count_only else np.asarray(ids, "<u4").tobytes()

    def _letters(self, piece: str, lead: str) -> list[int] | None:
        """Ids of a piece of Latin letters alone: it is one pre-token as it stands, so the library's model takes it straight away."""
        if not piece.isalpha():
            return None
        if not piece.isascii():
            try:
                piece.encode("latin-1")
            except UnicodeEncodeError:
                return None
        if self.kind == "dropped" and piece != piece.lower():
            return None
        return [x.id for x in self.model.model.tokenize((self.spelt_space if lead else "") + piece.translate(self.spelling))]

    def _learn(self, pieces: _Pieces, wanted: set[str]) -> None:
        """Encode new pieces together, joined by a mark whose id occurs in none of them; a word that ends in one sign is the word and the sign."""
        pieces.brief = {}
        new = {p for p in wanted if p not in pieces}  # not a difference of key views: that goes through the whole cache
        ends = {p: p[:-1] for p in new if p[-1:] in MARKS and p[-2:-1].isalpha()}
        todo = [p for p in {ends.get(p, p) for p in new} if p and p not in pieces and len(p) <= self.max_piece and self.mark not in p]
        rest = []
        for p in todo:
            if (ids := self._letters(p, pieces.lead)) is None:
                rest.append(p)
            else:
                (pieces if len(pieces) < self.max_pieces else pieces.brief)[p] = self.pack(ids)
        joint = f" {self.mark} " if self.kind == "dropped" else self.mark + pieces.lead
        for i in range(0, len(rest), 100):
            some = rest[i : i + 100]
            ids = np.asarray(self.library_ids(pieces.lead + joint.join(some)), "<u4")
            cuts = np.flatnonzero(ids == self.mark_id).tolist()
            if len(cuts) != len(some) - 1:
                continue
            spans = zip(some, [0, *(c + 1 for c in cuts)], [*cuts, len(ids)])
            to = pieces if len(pieces) + len(some) <= self.max_pieces else pieces.brief
            if self.count_only:
                to.update((p, e - s) for p, s, e in spans)
            else:
                raw = ids.tobytes()
                to.update((p, raw[4 * s : 4 * e]) for p, s, e in spans)
        to = pieces if len(pieces) + len(ends) <= self.max_pieces else pieces.brief
        to.update((p, pieces[stem] + self.bare[p[-1]]) for p, stem in ends.items() if len(p) <= self.max_piece)

    def _cut(self, text: str) -> list[list[str]] | None:
        """The lines of a text, in pieces; None where there is no safe place to cut."""
        flat = text.replace("\n", " ")
        if not flat.isprintable() or any(x in text for x in self.specials):
            return None
        if self.kind == "dropped":
            try:
                flat.encode("latin-1")
                flat = flat.lower()
            except UnicodeEncodeError:
                pass
            return [flat.split(" ")]
        lines = [x.split(" ") for x in text.split("\n")]
        return None if any("" in x for x in lines) else lines

    def ids(self, texts: list[str]) -> list:
        if self.kind in ("whole", "pieces"):
            return [self.pack(self.library_ids(x)) for x in texts]
        cut = [self._cut(x) for x in texts]
        lines = [x for c in cut if c for x in c]
        rows = lines, [self._known(x) for x in lines]
        first, rest = set(), set()
        for words, got in zip(*rows):
            if None in got:
                if got[0] is None:
                    first.add(words[0])
                rest.update(w for w, g in zip(words[1:], got[1:]) if g is None)
        if self.kind == "dropped":
            self._learn(self.bare, first | rest)
        else:
            self._learn(self.bare, first)
            self._learn(self.spaced, rest)
        done = iter(zip(*rows))
        out = []
        for text, own in zip(texts, cut):
            if own is None:
                out.append(self.pack(self.library_ids(text)))
                continue
            each = []
            for _ in own:
                words, got = next(done)
                if None in got:
                    got = [self.bare[words[0]], *[self.spaced[w] if g is None else g for w, g in zip(words[1:], got[1:])]]
                each.append(sum(got) if self.count_only else b"".join(got))
            out.append(sum(each) + self.newline * (len(each) - 1) if self.count_only else self.newline.join(each))
        return out

    def _known(self, words: list[str]) -> list:
        got = [*map(self.spaced.get, words)]
        if self.kind == "leading":
            got[0] = self.bare.get(words[0])
        return got


#: Signs that are pieces of their own after a letter.
MARKS = frozenset(".,;:!?")


def _kind(described: dict) -> str:
    """Which spaces are safe to cut at; "whole" where this is not known."""
    if (described.get("model") or {}).get("type") != "BPE" or (described["model"].get("dropout") or 0) or described.get("post_processor") and described["post_processor"].get("type") not in ("ByteLevel", "RobertaProcessing", "TemplateProcessing"):
        return "whole"
    norm, pre = described.get("normalizer"), described.get("pre_tokenizer") or {}
    if norm is None and pre.get("type") == "ByteLevel" and pre.get("use_regex", True) and not pre.get("add_prefix_space"):
        return "leading"
    steps = pre.get("pretokenizers") or []
    names = [x.get("type") for x in (norm or {}).get("normalizers") or []]
    if names == ["NFC", "Replace", "Lowercase"] and [x.get("type") for x in steps] == ["Split", "ByteLevel"] and steps[0].get("invert") and steps[0].get("behavior") == "Removed" and not steps[1].get("use_regex"):
        return "dropped"
    return "whole"


_encoders: dict[tuple, TextEncoder] = {}


def encoder(path: str, **options) -> TextEncoder:
    """One encoder for each Python worker and tokenizer file; its cache serves all of the worker's tasks."""
    key = (path, *sorted(options.items()))
    if key not in _encoders:
        _encoders.clear()
        _encoders[key] = TextEncoder(path, **options)
    return _encoders[key]


def tokenizer_path(name: str) -> str:
    """Place of a public tokenizer file on this machine."""
    import public_tokenizers

    return public_tokenizers.path(name)
