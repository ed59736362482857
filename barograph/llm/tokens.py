"""Encoding of whole texts with a public word-level BPE vocabulary."""

from __future__ import annotations

import json
import os
import re
import unicodedata
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Trailing marks that are a piece of their own after letters. The apostrophe is not among them.
_TAIL = ".,;:!?|%&*#$()[]-+=/\"@~^_{}`\\"

#: The vocabulary's pattern in ASCII and lower case.
_RUNS = re.compile(r"'(?:s|t|re|ve|m|ll|d)|[a-z]+|[0-9]|[^a-z0-9 \t-\r]+")


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def gather(flat: np.ndarray, lengths: np.ndarray, index: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The stretches of flat (of these lengths, one after another) in the order of index, and their lengths."""
    starts, n = np.cumsum(lengths) - lengths, lengths[index]
    ends = np.cumsum(n)
    kind = np.int32 if len(flat) < 2**31 and (not len(n) or ends[-1] < 2**31) else np.int64
    places = np.repeat((starts[index] - (ends - n)).astype(kind), n)
    places += np.arange(len(places), dtype=kind)
    return flat[places], n


def unpacked(words: pa.Array) -> list[str]:
    """The strings of an array without nulls and white space, by way of one string."""
    if not len(words):
        return []
    return pc.binary_join(pa.LargeListArray.from_arrays(pa.array([0, len(words)], pa.int64()), words), " ")[0].as_py().split(" ")


def runs_of(word: str) -> int:
    """Of how many runs of letters, digits and marks the vocabulary makes a word; 0 if that is not sure."""
    if word.isascii():
        return 0 if "<|" in word else len(_RUNS.findall(word.lower()))
    word = unicodedata.normalize("NFC", word)
    low = word.lower()
    return int(word.isalpha() and low.isalpha() and len(low) == len(word))


class WordEncoder:
    """Ids of texts as little-endian unsigned 32-bit bytes.

    The vocabulary drops white space, lower-cases, and splits between letters and marks before it
    merges, so a text's ids are its words' ids one after another, and a word's are those of its
    letters and its trailing marks. A batch of texts is reduced to its distinct words and these to
    their distinct letters and marks; what is new of those goes to the tokenizers library, many words at a
    time: every run of letters or marks and every digit ends in a token with the end-of-word mark, so
    the words' ids can be told apart. Other words outside ASCII go one by one. When more than `most` pieces are known, only those of the batch at hand stay.
    """

    def __init__(self, path: str, most: int = 300_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            suffix = json.load(f)["model"]["end_of_word_suffix"]
        self.tokenizer, self.most, self.known = Tokenizer.from_file(path), most, {"": b""}
        self.ends = np.zeros(self.tokenizer.get_vocab_size() + 1, bool)
        for token, i in self.tokenizer.get_vocab(False).items():
            self.ends[i] = bool(suffix) and token.endswith(suffix)
        self.plain = bool(suffix)

    def one_by_one(self, words: list[str]) -> dict:
        coded = self.tokenizer.encode_batch_fast(words, add_special_tokens=False)
        return {w: np.asarray(e.ids, "<u4").tobytes() for w, e in zip(words, coded, strict=True)}

    def together(self, words: list[str], runs: list[int]) -> dict:
        """runs: of how many runs of letters, digits and marks each word is; each ends in a marked token."""
        found = {}
        for k in range(0, len(words), 20_000):
            part, last = words[k : k + 20_000], np.cumsum(runs[k : k + 20_000])
            ids = np.asarray(self.tokenizer.encode_batch_fast([" ".join(part)], add_special_tokens=False)[0].ids, "<u4")
            stops = (np.flatnonzero(self.ends[ids]) + 1) * 4
            if len(stops) != last[-1]:
                return self.one_by_one(words)
            raw, stops = ids.tobytes(), stops[last - 1].tolist()
            found.update(zip(part, (raw[a:b] for a, b in zip([0, *stops[:-1]], stops, strict=True)), strict=True))
        return found

    def pieces(self, words: pa.Array) -> pa.Array:
        """Two strings a word: its letters in lower case and its trailing marks, or the whole word and
        nothing. Letters outside ASCII stay as they are, and count only if lower case leaves them
        letters, one for one (U+0130 becomes two), and if they are below U+0300, where nothing is to be
        composed."""
        core = pc.ascii_rtrim(words, _TAIL)
        low = pc.utf8_lower(core)
        letters = pc.and_(pc.utf8_is_alpha(core), pc.utf8_is_alpha(low))
        letters = pc.and_(letters, pc.equal(pc.utf8_length(low), pc.utf8_length(core)))
        letters = pc.and_not(letters, pc.match_substring_regex(core, r"[^\x{0}-\x{2ff}]|\x{130}")).to_numpy(zero_copy_only=False) & self.plain
        words = pa.concat_arrays([words])  # offsets from 0
        offsets = np.frombuffer(words.buffers()[1], np.int32)[: len(words) + 1].astype(np.int64)
        cut = np.where(letters, offsets[:-1] + pc.binary_length(core).to_numpy(), offsets[1:])
        both = np.empty(2 * len(words) + 1, np.int32)
        both[0::2], both[1::2] = offsets, cut
        split = pa.StringArray.from_buffers(2 * len(words), pa.py_buffer(both), words.buffers()[2])
        return pc.if_else(pa.array(np.repeat(letters, 2)), pc.ascii_lower(split), split)

    def __call__(self, texts: pa.Array) -> list[bytes]:
        texts = pc.fill_null(texts.cast(pa.string()), "")
        lists = pc.ascii_split_whitespace(texts)
        first = lists.offsets[0].as_py() if len(lists) else 0
        coded = lists.flatten().dictionary_encode()
        parts = self.pieces(coded.dictionary).dictionary_encode()
        names = unpacked(parts.dictionary)
        if len(self.known) > self.most:
            self.known = {n: self.known[n] for n in {*names, ""} & self.known.keys()}
        new = [n for n in names if n not in self.known]
        runs = [runs_of(n) if self.plain else 0 for n in new]
        self.known.update(self.together([n for n, k in zip(new, runs, strict=True) if k], [k for k in runs if k]))
        self.known.update(self.one_by_one([n for n, k in zip(new, runs, strict=True) if not k]))
        ids = list(map(self.known.__getitem__, names))
        lengths = np.fromiter(map(len, ids), np.int64, len(ids)) // 4
        flat, n = gather(np.frombuffer(b"".join(ids), "<u4"), lengths, parts.indices.to_numpy())
        flat, n = gather(flat, n[0::2] + n[1::2], coded.indices.to_numpy())
        ends = np.append(0, np.cumsum(n))[lists.offsets.to_numpy() - first] * 4
        raw = flat.tobytes()
        return [raw[a:b] for a, b in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)]


@lru_cache(maxsize=1)
def encoder(path: str) -> WordEncoder:
    """The worker's encoder: tasks that follow one another in a worker share its look-up table."""
    return WordEncoder(path)
