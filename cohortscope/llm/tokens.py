"""Token ids of whole texts with a vocabulary file of the tokenizers library.

With a vocabulary whose rules are ``WORD_RULES``, a text is cut at white space, which those rules drop, and the
library encodes each distinct piece of a batch once. Words and the marks behind them are encoded apart in any
case, and small letters are all the vocabulary sees, so plain words are told apart without either. With any
other vocabulary (one that keeps white space or capitals, say) the library encodes each text whole.
"""

from __future__ import annotations

import json
import os

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Characters given to ``encode`` at a time: the more, the fewer distinct pieces are encoded again.
SLICE = 12_000_000
#: Distinct pieces given to the library at a time.
ENCODED = 20_000
#: Pieces whose ids are put together at a time.
GATHERED = 1 << 18
#: A fixed value of the vocabulary: a special token, put between pieces that are encoded together.
SEPARATOR = "<|startoftext|>"
#: Control characters that Arrow splits at although they aren't white space to the library.
NOT_SPACE = r"[\x1c-\x1f]"
#: Words of Latin letters, which never combine with what follows, and the marks behind them.
PLAIN = r"^(?P<word>[A-Za-zÀ-ÖØ-öø-ÿ]+)(?P<marks>[!-/:-@\[-`{-~]*)$"
#: Characters given to the library at a time where texts are encoded whole.
WHOLE = 1_000_000
#: The rules of a vocabulary file under which pieces between white space are independent.
WORD_RULES = {
    "normalizer": {
        "type": "Sequence",
        "normalizers": [
            {"type": "NFC"},
            {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "},
            {"type": "Lowercase"},
        ],
    },
    "pre_tokenizer": {
        "type": "Sequence",
        "pretokenizers": [
            {
                "type": "Split",
                "pattern": {"Regex": "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"},
                "behavior": "Removed",
                "invert": True,
            },
            {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
        ],
    },
}

_encoders: dict[str, "PieceEncoder"] = {}


def _cuts_at_space(tokenizer) -> bool:
    """Whether texts may be cut at white space: the rules are ``WORD_RULES`` and nothing else acts on a text."""
    model, parts = tokenizer.model, {name: getattr(tokenizer, name) for name in WORD_RULES}
    return (
        all(part is not None and json.loads(part.__getstate__()) == WORD_RULES[name] for name, part in parts.items())
        and getattr(model, "end_of_word_suffix", None) == "</w>"
        and not model.dropout
        and tokenizer.post_processor is tokenizer.truncation is tokenizer.padding is None
        and all(
            added.content.startswith("<|") and added.content.endswith("|>")
            and not (added.lstrip or added.rstrip or added.single_word or added.normalized)
            for added in tokenizer.get_added_tokens_decoder().values()
        )
    )


class PieceEncoder:
    """Encodes texts with one vocabulary file; a worker keeps one instance per file."""

    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.by_pieces = _cuts_at_space(self.tokenizer)
        self.separator = self.tokenizer.token_to_id(SEPARATOR)
        names = self.tokenizer.get_vocab(with_added_tokens=True)
        self.dtype = np.dtype("<u4" if max(names.values()) >= 1 << 16 else "<u2")
        self.ends_word = np.zeros(max(names.values()) + 1, bool)
        self.ends_word[[i for name, i in names.items() if name.endswith("</w>")]] = True

    def _ids(self, text: str) -> np.ndarray:
        encoded = self.tokenizer.encode_batch_fast([text], add_special_tokens=False)
        return np.array(encoded[0].ids, dtype=self.dtype)

    def _in_groups(self, encode, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """``encode`` over groups of pieces; the library needs far more memory than its text has."""
        parts = [encode(pieces[a : a + ENCODED]) for a in range(0, len(pieces), ENCODED)]
        ids = np.concatenate([np.zeros(0, self.dtype), *(p[0] for p in parts)])
        return ids, np.concatenate([np.zeros(0, np.int64), *(p[1] for p in parts)])

    def _words(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of words of letters on end, and each one's number of ids."""
        ids = self._ids(" ".join(words))
        last = np.flatnonzero(self.ends_word[ids])
        if len(last) != len(words):
            return self._pieces(words)
        return ids, np.diff(last, prepend=-1)

    def _pieces(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The same for any pieces; those that may hold a special token are encoded on their own."""
        if self.separator is not None and not any("<|" in p or "|>" in p for p in pieces):
            ids = self._ids(SEPARATOR.join(pieces))
            cuts = np.flatnonzero(ids == self.separator)
            if len(cuts) == len(pieces) - 1:
                return np.delete(ids, cuts), np.diff(cuts, prepend=-1, append=len(ids)) - 1
        each = [self._ids(p) for p in pieces]
        return np.concatenate([np.zeros(0, self.dtype), *each]), np.array([len(i) for i in each], np.int64)

    def _lookup(self, pieces: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of distinct pieces on end, and each one's number of ids."""
        if not len(pieces):
            return np.zeros(0, self.dtype), np.zeros(0, np.int64)
        parts = pc.extract_regex(pieces, PLAIN)
        plain = parts.is_valid()
        words = pc.utf8_lower(pc.struct_field(parts.filter(plain), "word")).dictionary_encode()
        marks = pc.struct_field(parts.filter(plain), "marks").dictionary_encode()
        others = pieces.filter(pc.invert(plain)).to_pylist()
        odd = [p for p in others if "<|" in p or "|>" in p]
        usual = [p for p in others if not ("<|" in p or "|>" in p)]
        stores, sizes, begin = [], [], [0]
        for store, size in (
            self._in_groups(self._words, words.dictionary.to_pylist()),
            self._in_groups(self._pieces, marks.dictionary.to_pylist()),
            self._in_groups(self._pieces, usual),
            self._in_groups(self._pieces, odd),
        ):
            stores.append(store)
            sizes.append(size)
            begin.append(begin[-1] + len(size))
        # Each piece is a word and its marks; for other pieces the marks are entry ``begin[4]``, empty.
        first = np.empty(len(pieces), np.int64)
        second = np.full(len(pieces), begin[4], np.int64)
        is_plain = plain.to_numpy(zero_copy_only=False)
        first[is_plain] = words.indices.to_numpy(zero_copy_only=False)
        second[is_plain] = marks.indices.to_numpy(zero_copy_only=False) + begin[1]
        is_odd = np.array(["<|" in p or "|>" in p for p in others], bool)
        rest = np.empty(len(others), np.int64)
        rest[~is_odd] = np.arange(len(usual)) + begin[2]
        rest[is_odd] = np.arange(len(odd)) + begin[3]
        first[~is_plain] = rest
        sizes = np.concatenate([*sizes, [0]])
        ids, _ = gather(np.concatenate(stores), sizes, np.stack([first, second], axis=1).ravel())
        return ids, sizes[first] + sizes[second]

    def _whole(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """``encode`` without cutting: groups of texts of some ``WHOLE`` characters, one at least."""
        texts = texts.fill_null("")
        sizes = pc.utf8_length(texts).to_numpy(zero_copy_only=False)
        group = (np.cumsum(sizes) - sizes) // WHOLE
        cuts = [*np.flatnonzero(np.diff(group, prepend=-1)), len(texts)]
        parts = []
        for a, z in zip(cuts[:-1], cuts[1:], strict=True):
            found = self.tokenizer.encode_batch_fast(texts[int(a) : int(z)].to_pylist(), add_special_tokens=False)
            parts += [np.array(e.ids, dtype=self.dtype) for e in found]
        offsets = np.concatenate([[0], np.cumsum([len(p) for p in parts], dtype=np.int64)]).astype(np.int64)
        return np.concatenate([np.zeros(0, self.dtype), *parts]), offsets

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts on end, and where each text's ids begin (and the last ones end).

        Each text's ids equal those of encoding it in one piece. A null text has none.
        """
        texts = texts.cast(pa.large_string())
        if not self.by_pieces:
            return self._whole(texts)
        odd = pc.match_substring_regex(texts, NOT_SPACE).fill_null(False)
        any_odd = pc.any(odd).as_py()
        split = pc.utf8_split_whitespace((pc.if_else(odd, "", texts) if any_odd else texts).fill_null(""))
        pieces = split.flatten().dictionary_encode()
        ids, ends = gather(*self._lookup(pieces.dictionary), pieces.indices.to_numpy(zero_copy_only=False))
        bounds = split.offsets.to_numpy() - split.offsets[0].as_py()
        offsets = ends[bounds]
        if any_odd:
            parts = [ids[a:z] for a, z in zip(offsets[:-1], offsets[1:], strict=True)]
            for i in np.flatnonzero(odd.to_numpy(zero_copy_only=False)):
                parts[i] = self._ids(texts[i].as_py())
            offsets = np.concatenate([[0], np.cumsum([len(p) for p in parts])])
            ids = np.concatenate(parts)
        return ids, offsets


def gather(store: np.ndarray, sizes: np.ndarray, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The runs ``which`` of a store of runs with these sizes, on end, and where each begins and ends."""
    begins, counts = np.cumsum(sizes) - sizes, sizes[which]
    ends = np.concatenate([[0], np.cumsum(counts)])
    out = np.empty(ends[-1], store.dtype)
    for a in range(0, len(which), GATHERED):
        z = min(a + GATHERED, len(which))
        shift = np.repeat(begins[which[a:z]] - ends[a:z], counts[a:z])
        out[ends[a] : ends[z]] = store[shift + np.arange(ends[a], ends[z])]
    return out, ends


def encoder(path: str) -> PieceEncoder:
    if path not in _encoders:
        _encoders[path] = PieceEncoder(path)
    return _encoders[path]


def vocabulary(name: str) -> str:
    """The path of a public vocabulary file, the same on every machine that has the package."""
    import public_tokenizers

    return public_tokenizers.path(name)
