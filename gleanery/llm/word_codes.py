"""Token ids of many texts, each distinct word of a run encoded once.

A public tokenizer whose pre-tokenizer never joins what stands on two sides of white space
gives a text the ids of its words in a row. Arrow cuts a run of texts into words and
numbers the distinct ones, the tokenizer encodes those, and numpy lays their ids out
in the order of the texts. Words are remembered for the next runs, up to a bound; beyond
that memory is that of a run. A mark behind a letter begins a word of its own there, as it
does in the pre-tokenizers, so that a word is encoded once whatever mark follows it.

Two pre-tokenizers are known; their settings are compared, not guessed. One drops white
space; of the other a single space belongs to the word after it. Texts of any other
tokenizer, and those with other white space than the rule allows, are encoded whole.
"""

from __future__ import annotations

import json
import os
import sys
from types import ModuleType

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from gleanery.llm.common import runs_of_texts, utf8_buffer

# Settings of the two pre-tokenizers and of the normalizers beside them.
WORDS_ONLY = {
    "type": "Sequence",
    "pretokenizers": [
        {
            "type": "Split",
            "pattern": {"Regex": r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"},
            "behavior": "Removed",
            "invert": True,
        },
        {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
    ],
}
WORDS_ONLY_NORMALIZER = {
    "type": "Sequence",
    "normalizers": [
        {"type": "NFC"},
        {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "},
        {"type": "Lowercase"},
    ],
}
SPACE_LEADS = {"type": "ByteLevel", "add_prefix_space": False, "use_regex": True}

# Begins a word that follows what is before it without a space.
GLUE = "\0"
# White space or controls other than single spaces and line breaks between characters.
_IRREGULAR = (
    r"^[ \n]|[ \n]\z|[ \n][ \n]|[\x00-\x09\x0b-\x1f\x7f-\x{a0}\x{1680}\x{180e}\x{2000}-\x{200f}"
    r"\x{2028}-\x{202f}\x{205f}-\x{206f}\x{3000}\x{feff}]"
)
# A letter and the mark behind it. Of these letters lower case and NFC make no other kind of
# character, and no mark joins them.
_MARK_BEHIND = r"([a-zß-öø-ÿα-ωа-я])([!-/:-@\[-`{-~])"
# Bytes of text whose words are encoded together, and words remembered between such runs.
RUN_BYTES = 2 << 20
KNOWN_WORDS = 150_000
# Words in one call text, and call texts at a time.
_JOINED = 64
_CALL_TEXTS = 256


def _text(text: str) -> pa.Scalar:
    return pa.scalar(text, pa.large_string())


def _laid_out(ids: np.ndarray, first: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Runs of ids, one after another."""
    end = np.cumsum(counts)
    place = np.arange(int(end[-1]) if len(end) else 0, dtype=np.int32)
    place += np.repeat((first - (end - counts)).astype(np.int32), counts)
    return ids[place]


class WordEncoder:
    def __init__(self, path: str):
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.tokenizer = Tokenizer.from_file(path)
        self.width = 2 if self.tokenizer.get_vocab_size() <= 1 << 16 else 4
        added = self.tokenizer.get_added_tokens_decoder()
        self.special = [t.content for t in added.values()]
        settings = json.loads(self.tokenizer.to_str())
        rules, normalizer = settings["pre_tokenizer"], settings["normalizer"]
        self.drops = rules == WORDS_ONLY and normalizer == WORDS_ONLY_NORMALIZER
        leads = {k: v for k, v in (rules or {}).items() if k != "trim_offsets"} == SPACE_LEADS
        self.leads = leads and normalizer is None
        plain = [t for t in added.values() if t.special and not (t.lstrip or t.rstrip or t.single_word)]
        self.mark = plain[0].content if len(plain) == len(added) and plain else None
        self.by_words = self.mark is not None and (self.drops or self.leads)
        if self.by_words:
            # Tokens that end a word of letters, or begin one behind a space.
            vocabulary = self.tokenizer.get_vocab()
            self.edge = np.zeros(max(vocabulary.values()) + 1, bool)
            self.edge[[k for t, k in vocabulary.items() if (t.endswith("</w>") if self.drops else t[0] == "Ġ")]] = True
        self._forget()

    def _forget(self) -> None:
        self.known = pa.array([], pa.large_string())
        self.known_runs = np.zeros(0, np.int32)
        self.known_ids = np.zeros(0, "<u4")
        self.known_first = self.known_counts = np.zeros(0, np.int64)

    def _whole(self, texts: list[str]) -> list[np.ndarray]:
        found: list[np.ndarray] = []
        for at in range(0, len(texts), _CALL_TEXTS):
            coded = self.tokenizer.encode_batch_fast(texts[at : at + _CALL_TEXTS], add_special_tokens=False)
            found += [np.array(x.ids, "<u4") for x in coded]
        return found

    def _letters(self, words: list[str]) -> tuple[np.ndarray, np.ndarray] | None:
        """Ids and counts of words of letters, many in one text. Each is one piece of the
        pre-tokenizer and has one token at its edge, unless the normalizer makes other
        characters of its letters: then there are more edges, and the answer is None."""
        lead = "" if self.drops else " "
        texts = [lead + " ".join(words[at : at + _JOINED]) for at in range(0, len(words), _JOINED)]
        flat = np.concatenate([np.zeros(0, "<u4"), *self._whole(texts)])
        edges = np.flatnonzero(self.edge[flat])
        if len(edges) != len(words):
            return None
        ends = edges + 1 if self.drops else np.append(edges[1:], len(flat))
        return flat, np.diff(np.concatenate([[0], ends[: len(words)]]))

    def _marked(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids and counts of any words, many in one text with a special token between them."""
        mark = self.tokenizer.token_to_id(self.mark)
        joined = [self.mark.join(words[at : at + _JOINED]) for at in range(0, len(words), _JOINED)]
        # A mark after each call text too, so that marks and words alternate.
        found = [np.append(ids, np.uint32(mark)) for ids in self._whole(joined)]
        flat = np.concatenate([np.zeros(0, "<u4"), *found])
        counts = np.diff(np.concatenate([[-1], np.flatnonzero(flat == mark)])) - 1
        return flat[flat != mark], counts

    def _in_text(self, words: list[str]) -> list[str]:
        """Words as they stand in a text, with the space before them that belongs to them."""
        if self.drops:
            return words
        return [w[1:] if w[:1] == GLUE else " " + w for w in words]

    def _codes(self, words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids, and for each word its first place there and its count."""
        first, last = self.mark[:1], self.mark[-1:]
        is_letters = np.fromiter(map(str.isalpha, words), bool, len(words))
        letters = np.flatnonzero(is_letters).tolist()
        found = [self._letters([words[k] for k in letters])]
        others = np.flatnonzero(~is_letters).tolist()
        if found[0] is None:
            letters, others, found = [], list(range(len(words))), []
        others_as = dict(zip(others, self._in_text([words[k] for k in others])))
        marked, alone = [], []
        for k, word in others_as.items():
            (alone if first in word or last in word else marked).append(k)
        found.append(self._marked([others_as[k] for k in marked]))
        whole = self._whole([others_as[k] for k in alone])
        found.append((np.concatenate([np.zeros(0, "<u4"), *whole]), np.array([len(w) for w in whole], np.int64)))
        order = np.array(letters + marked + alone, np.int64)
        counted = np.concatenate([c for _, c in found])
        counts, firsts = np.zeros(len(words), np.int64), np.zeros(len(words), np.int64)
        counts[order], firsts[order] = counted, np.cumsum(counted) - counted
        return np.concatenate([ids for ids, _ in found]), firsts, counts

    def _by_words(self, texts) -> list[np.ndarray]:
        if self.drops:
            units = pc.ascii_split_whitespace(texts)
        else:
            glued = pc.replace_substring(texts, "\n", f" {GLUE}\n")
            units = pc.split_pattern(pc.binary_join_element_wise(_text(GLUE), glued, _text("")), " ")
        coded = units.flatten().dictionary_encode()
        word = coded.indices.to_numpy()
        ids, first, counts = self._in_parts(coded.dictionary)
        laid = _laid_out(ids, first[word], counts[word])
        bounds = units.offsets.to_numpy() - units.offsets[0].as_py()
        at = np.concatenate([[0], np.cumsum(counts[word])])[bounds]
        return np.split(laid, at[1:-1]) if len(at) > 1 else []

    def _in_parts(self, words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids of distinct words, and for each its first place and count. Those with marks
        behind letters have the ids of their parts in a row; special tokens are not cut."""
        cut = pc.match_substring_regex(words, _MARK_BEHIND)
        for name in self.special:
            cut = pc.and_not(cut, pc.match_substring(words, name))
        whole, pieced = words.filter(pc.invert(cut)), words.filter(cut)
        parts = pc.replace_substring_regex(pieced, _MARK_BEHIND, r"\1 \2" if self.drops else rf"\1 {GLUE}\2")
        parts = pc.split_pattern(parts, " ")
        coded = pa.concat_arrays([whole, parts.flatten()]).dictionary_encode()
        part = coded.indices.to_numpy()
        ids, first, counts = self._with_known(coded.dictionary)
        bounds = np.concatenate([np.arange(len(whole)), len(whole) + parts.offsets.to_numpy()])
        ends = np.concatenate([[0], np.cumsum(counts[part])])[bounds]
        order = np.argsort(cut.to_numpy(zero_copy_only=False), kind="stable")
        firsts, lengths = np.zeros(len(words), np.int64), np.zeros(len(words), np.int64)
        firsts[order], lengths[order] = ends[:-1], np.diff(ends)
        return _laid_out(ids, first[part], counts[part]), firsts, lengths

    def _with_known(self, words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids of known and new words, and for each of `words` its first place and count."""
        known = len(self.known)
        places = pc.fill_null(pc.index_in(words, value_set=self.known), -1).to_numpy().astype(np.int64)
        new = np.flatnonzero(places < 0)
        self.known_runs[places[places >= 0]] += 1
        places[new] = known + np.arange(len(new))
        new_words = words.take(pa.array(new))
        new_ids, new_first, new_counts = self._codes(new_words.to_numpy(zero_copy_only=False).tolist())
        self.known = pa.concat_arrays([self.known, new_words])
        self.known_runs = np.concatenate([self.known_runs, np.ones(len(new), np.int32)])
        self.known_first = np.concatenate([self.known_first, len(self.known_ids) + new_first])
        self.known_counts = np.concatenate([self.known_counts, new_counts])
        self.known_ids = np.concatenate([self.known_ids, new_ids])
        found = self.known_ids, self.known_first[places], self.known_counts[places]
        if len(self.known) > KNOWN_WORDS:
            self._keep_met_again()
        return found

    def _keep_met_again(self) -> None:
        """Of the known words those of several runs stay, unless they are too many themselves."""
        kept = np.flatnonzero(self.known_runs > 1)
        if len(kept) > KNOWN_WORDS // 2:
            return self._forget()
        counts = self.known_counts[kept]
        self.known_ids = _laid_out(self.known_ids, self.known_first[kept], counts)
        self.known_first, self.known_counts = np.cumsum(counts) - counts, counts
        self.known, self.known_runs = self.known.take(pa.array(kept)), np.ones(len(kept), np.int32)

    def encode(self, texts) -> list[np.ndarray]:
        """Ids of each text of an Arrow array; a null text is empty."""
        texts = pc.fill_null(texts, "").cast(pa.large_string())
        if not self.by_words:
            return self._whole(texts.to_pylist())
        if self.drops:
            return self._by_words(texts)
        odd = pc.match_substring_regex(texts, _IRREGULAR)
        for name in self.special:
            odd = pc.or_(odd, pc.match_substring(texts, name))
        whole = iter(self._whole(texts.filter(odd).to_pylist()))
        pieced = iter(self._by_words(texts.filter(pc.invert(odd))))
        return [next(whole if is_odd else pieced) for is_odd in odd.to_pylist()]


def word_encoder(path: str) -> WordEncoder:
    """The encoder of this process. Functions come to a worker by value and with new globals
    for each task, so it is kept with the modules, which stay."""
    held = sys.modules.setdefault("_word_encoders", ModuleType("_word_encoders")).__dict__
    if path not in held:
        held[path] = WordEncoder(path)
    return held[path]


def encoded_runs(texts, path: str):
    """(position, ids) of each text of an Arrow array, a run of RUN_BYTES at a time."""
    _, bounds = utf8_buffer(texts)
    encoder = word_encoder(path)
    for first, last in runs_of_texts(bounds, RUN_BYTES):
        yield from zip(range(first, last), encoder.encode(texts.slice(first, last - first)))
        pa.default_memory_pool().release_unused()  # else each worker keeps the most it ever held
