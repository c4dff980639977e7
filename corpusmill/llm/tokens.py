"""Token ids of whole texts, by a public tokenizer file."""

from __future__ import annotations

import os

from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from corpusmill.llm.common import word_codes

#: White space of the tokenizer's pre-splitting rule, as a character class.
SPACE = r"[\t-\r \x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"
#: A blank inside or at the end of a longer run of white space; there the rule does not begin a new piece.
TIED_BLANK = f"{SPACE} (?:{SPACE}|$)"
SEPARATOR = "<|endoftext|>"
LATIN = r"A-Za-z\x{C0}-\x{D6}\x{D8}-\x{F6}\x{F8}-\x{24F}"
#: A run of Latin letters that an ASCII character other than a letter follows: the rule ends a piece between them.
LETTERS_FIRST = rf"^(?P<a> ?[{LATIN}]+)(?P<b>[\n!-@\[-`{{-~](?s:.*))$"
#: Exactly one piece of the rule, which the model can take as it is.
ONE_PIECE = rf"^ ?[{LATIN}]+$"
KNOWN_PIECES = 300_000
BLANK, NONE = pa.scalar(" ", pa.large_string()), pa.scalar("", pa.large_string())


def byte_letters() -> dict[int, int]:
    """The letters that byte-level models write for bytes: printable ones stand for themselves, the others for 256 and up."""
    printable = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in printable]
    return {b: 256 + k for k, b in enumerate(others)}


def as_list(strings: pa.Array) -> list[str]:
    """As to_pylist(), which makes a scalar of every string first."""
    return strings.to_numpy(zero_copy_only=False).tolist()


def default_tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


class Encoder:
    """Encodes Arrow arrays of texts with the tokenizers library; the ids equal those of encoding each text whole.

    Byte-level BPE never merges across the pieces of its pre-splitting rule, and that rule begins a new piece at a blank, unless
    the blank lies inside a longer run of white space. So a text is cut at its blanks, a cut that begins with letters also behind
    them; every distinct piece is encoded once, known pieces are kept up to a bound, and the ids are gathered back. Texts with
    such a longer run, or with the separator, are encoded whole.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.mark = self.tokenizer.token_to_id(SEPARATOR)
        self.letters = byte_letters()
        self.forget()

    def forget(self) -> None:
        self.known: dict[str, int] = {"": 0}
        self.lengths = np.zeros(1, np.int64)
        self.ids = np.zeros(0, np.uint32)

    def _learn(self, pieces: pa.Array) -> None:
        """Encode new pieces and keep their ids: words by the model, the rest in long strings joined by the separator."""
        is_word = pc.match_substring_regex(pieces, ONE_PIECE)
        words, rest = pieces.filter(is_word), as_list(pieces.filter(pc.invert(is_word)))
        model = self.tokenizer.model
        new = as_list(words)
        blank = chr(self.letters[32])
        written = (w.replace(" ", blank) if w.isascii() else w.encode().decode("latin-1").translate(self.letters) for w in new)
        found = [[t.id for t in tokens] for tokens in map(model.tokenize, written)]
        lengths = [np.fromiter(map(len, found), np.int64, len(found))]
        parts = [np.fromiter(chain.from_iterable(found), np.uint32)]
        for start in range(0, len(rest), 1024):
            joined = SEPARATOR.join(rest[start : start + 1024])
            ids = np.array(self.tokenizer.encode_batch_fast([joined], add_special_tokens=False)[0].ids, np.uint32)
            marks = np.flatnonzero(ids == self.mark)
            lengths.append(np.diff(np.concatenate([[-1], marks, [len(ids)]])) - 1)
            parts.append(np.delete(ids, marks))
        self.known.update(zip(chain(new, rest), range(len(self.known), len(self.known) + len(pieces))))
        self.ids, self.lengths = np.concatenate([self.ids, *parts]), np.concatenate([self.lengths, *lengths])

    def _distinct(self, pieces: pa.Array) -> pa.Array:
        """The ids of each of the given pieces, as a list array."""
        halves = pc.extract_regex(pieces, LETTERS_FIRST)
        cut = pc.is_valid(halves)
        both = pa.concat_arrays([pc.if_else(cut, pc.struct_field(halves, "a"), pieces), pc.if_else(cut, pc.struct_field(halves, "b"), NONE)])
        both = as_list(both)
        self._learn(pa.array(list(dict.fromkeys(p for p in both if p not in self.known)), pa.large_string()))
        place = np.fromiter(map(self.known.__getitem__, both), np.int64, len(both)).reshape(2, -1).T.ravel()
        starts = np.cumsum(self.lengths) - self.lengths
        counts = self.lengths[place]
        ends = np.cumsum(counts)
        total = int(ends[-1]) if len(ends) else 0
        ids = self.ids[np.arange(total) - np.repeat(ends - counts - starts[place], counts)]
        return pa.LargeListArray.from_arrays(pa.array(np.concatenate([[0], ends[1::2]])), pa.array(ids))

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids in text order, and the offset of each text among them (one more than texts). Null is empty."""
        if not len(texts):
            return np.zeros(0, np.uint32), np.zeros(1, np.int64)
        texts = pc.fill_null(texts, "").cast(pa.large_string())
        whole = pc.or_(pc.match_substring_regex(texts, TIED_BLANK), pc.match_substring(texts, SEPARATOR))
        words, codes, offsets = word_codes(pc.if_else(whole, "", texts))
        if len(self.known) > KNOWN_PIECES:
            self.forget()
        # The first cut of a text has no blank before it, the others do.
        first = codes[offsets[:-1]]
        bare = np.unique(first)
        pieces = pa.concat_arrays([pc.binary_join_element_wise(BLANK, words, NONE), words.take(pa.array(bare))])
        codes = codes.copy()
        codes[offsets[:-1]] = len(words) + np.searchsorted(bare, first)
        taken = self._distinct(pieces).take(pa.array(codes))
        ids = taken.flatten().to_numpy(zero_copy_only=False)
        bounds = taken.offsets.to_numpy(zero_copy_only=False)[offsets]
        bounds = bounds - bounds[0]
        direct = np.flatnonzero(whole.to_numpy(zero_copy_only=False))
        if not len(direct):
            return ids, bounds
        rows = [ids[a:b] for a, b in zip(bounds, bounds[1:])]
        for i in direct.tolist():
            rows[i] = np.array(self.tokenizer.encode_batch_fast([texts[i].as_py()], add_special_tokens=False)[0].ids, np.uint32)
        return np.concatenate(rows), np.concatenate([[0], np.cumsum([len(r) for r in rows])])


def shared_encoder(path: str) -> Encoder:
    """The encoder of this Python worker, kept from task to task so that known pieces stay known. It hangs on an imported module, because
    functions that travel by value have globals of their own in every task."""
    import tokenizers

    kept = tokenizers.__dict__.setdefault("_kept_encoders", {})
    if path not in kept:
        kept[path] = Encoder(path)
    return kept[path]


def encode_documents(encoder: Encoder, texts: pa.Array, end_id: int) -> tuple[np.ndarray, np.ndarray]:
    """As `Encoder.encode`, with the end id behind each text."""
    ids, bounds = encoder.encode(texts)
    ends = bounds[1:] + np.arange(len(bounds) - 1)
    out = np.empty(len(ids) + len(ends), "<u4")
    keep = np.ones(len(out), bool)
    keep[ends] = False
    out[ends], out[keep] = end_id, ids
    return out, bounds + np.arange(len(bounds))
