"""BPE encoding and decoding by prefix-sharing tries.

The file of a word-level BPE vocabulary (merges with an end-of-word suffix over byte symbols) is read as data.
Distinct words of a batch go into a trie, and a depth-first walk gives each node the last token of its prefix's
encoding, so a prefix that many words share is encoded once.  The last token of a prefix is the one suffix that is
a token and may follow the last token of what remains; two tokens may be neighbours if no merge across their
border comes due before those that built them.  Encoding a word is then a walk back over last tokens.
"""

from __future__ import annotations

import gc
import hashlib
import json
import re
import unicodedata

import regex
from pyspark.sql import DataFrame

from postmill.llm.common import map_texts

#: Fixed value: the characters that the vocabulary's normaliser turns into blanks.
WHITE = "\t-\r \x85\xa0  -     　"
_CHUNK = re.compile(f"[^{WHITE}]+")
_SEPARATORS = re.compile("[\x1c-\x1f]")  # str.split cuts here, the vocabulary does not
#: Entries of a worker's caches of chunks and of words, words of one trie, characters of texts that are read together.
CHUNK_CACHE, WORD_CACHE, TRIE_WORDS, GROUP_CHARS = 900_000, 1_200_000, 40_000, 8_000_000
#: Longer chunks and words are not kept, so the caches are bounded in bytes too.
KEEP_CHARS = 64


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte in the vocabulary."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    spare = iter(range(256, 512))
    return [chr(b) if b in shown else chr(next(spare)) for b in range(256)]


def lengths_by_end(tokens) -> dict[str, list[int]]:
    """Which lengths the tokens with a given last symbol, or last two symbols, have; longest first."""
    found: dict[str, set[int]] = {}
    for t in tokens:
        found.setdefault(t[-2:], {1}).add(len(t))
        if len(t) == 1:
            found.setdefault(t, {1})
    return {end: sorted(ks, reverse=True) for end, ks in found.items()}


class WordBPE:
    """Encoder and decoder for one vocabulary; ``spec`` is the parsed vocabulary file."""

    def __init__(self, spec: dict):
        model = spec["model"]
        self.suffix = model["end_of_word_suffix"] or ""
        self.ids: dict[str, int] = model["vocab"]
        self.names = {i: t for t, i in self.ids.items()}
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.names.update({i: t for t, i in self.special.items()})
        self.rank: dict[tuple[int, int], int] = {}
        self.parts: dict[int, tuple[int, int]] = {}
        self.born: dict[int, int] = {}
        for r, pair in enumerate(model["merges"]):
            a, b = pair if isinstance(pair, list) else pair.split(" ")
            key, made = (self.ids[a], self.ids[b]), self.ids[a + b]
            self.rank.setdefault(key, r)
            if made not in self.parts:
                self.parts[made], self.born[made] = key, r
        self.longest = max(len(t.removesuffix(self.suffix)) for t in self.ids)
        steps = spec["pre_tokenizer"]["pretokenizers"] if "pretokenizers" in spec["pre_tokenizer"] else [spec["pre_tokenizer"]]
        self.pattern = regex.compile(next(s["pattern"]["Regex"] for s in steps if s["type"] == "Split"))
        self.special_pattern = re.compile("(" + "|".join(map(re.escape, self.special)) + ")") if self.special else None
        self.symbol_table = dict(enumerate(byte_symbols()))
        self._fits: dict[tuple[int, int], bool] = {}
        self._whole: dict[int, bool] = {}
        self.inner = {t: i for t, i in self.ids.items() if self.whole(i) and not (self.suffix and t.endswith(self.suffix))}
        self.final = {t.removesuffix(self.suffix): i for t, i in self.ids.items()
                      if self.whole(i) and t.endswith(self.suffix)}
        self.inner_lengths, self.final_lengths = lengths_by_end(self.inner), lengths_by_end(self.final)

    # -- which tokens may stand side by side ---------------------------------------------------------------
    def fits(self, left: int, right: int) -> bool:
        """Whether an encoding may hold ``left`` directly before ``right``."""
        known = self._fits.get((left, right))
        if known is None:
            if len(self._fits) > 1_000_000:
                self._fits.clear()
            known = self._fits[left, right] = self._border_holds(left, right)
        return known

    def _border_holds(self, left: int, right: int) -> bool:
        # Go back in time: what stands at the border just before the later of the two was built.  A merge across
        # the border spoils the pair if it is due while both its sides stand; on a draw the left place goes first.
        born, never = self.born, 1 << 60
        left_ends, right_ends = never, never
        while True:
            due = self.rank.get((left, right))
            if due is not None and due < left_ends and due <= right_ends:
                return False
            at_left, at_right = born.get(left, -1), born.get(right, -1)
            if at_left < 0 and at_right < 0:
                return True
            if at_left > at_right:
                left, left_ends = self.parts[left][1], at_left
            else:
                right, right_ends = self.parts[right][0], at_right

    def whole(self, token: int) -> bool:
        """Whether the token's own text is encoded as this one token."""
        known = self._whole.get(token)
        if known is None:
            pair = self.parts.get(token)
            known = pair is None or (self.whole(pair[0]) and self.whole(pair[1]) and self._meets(token, pair))
            self._whole[token] = known
        return known

    def _meets(self, token: int, pair: tuple[int, int]) -> bool:
        rank = self.rank.pop(pair)
        try:
            return self._border_holds(*pair) and self.born[token] == rank
        finally:
            self.rank[pair] = rank

    # -- encoding ------------------------------------------------------------------------------------------
    def encode_words(self, words) -> dict[str, list[int]]:
        """Token ids of each distinct word, given as byte symbols."""
        words = sorted(words)  # neighbours share prefixes
        out: dict[str, list[int]] = {}
        for start in range(0, len(words), TRIE_WORDS):
            self._walk(words[start:start + TRIE_WORDS], out)
        return out

    def _last(self, tail: str, depth: int, last: list[int], tokens: dict, lengths: dict) -> tuple[int, int]:
        for k in lengths.get(tail[-2:]) or lengths[tail[-1]]:
            if k <= depth:
                token = tokens.get(tail[-k:])
                if token is not None:
                    if k == depth:
                        return token, 0
                    before = last[depth - k]
                    known = self._fits.get((before, token))
                    if known or known is None and self.fits(before, token):
                        return token, depth - k
        raise ValueError(f"no token ends {tail!r}")

    def _walk(self, words: list[str], out: dict[str, list[int]]) -> None:
        root: dict = {}
        for w in words:
            node = root
            for ch in w[:-1]:
                nxt = node.get(ch)
                if nxt is None:
                    nxt = node[ch] = {}
                node = nxt
            node.setdefault("", []).append(w)
        last, back = [0], [0]  # by depth: last token of the current prefix, and the depth where it starts
        stack = [("", 0, root)]
        while stack:
            tail, depth, node = stack.pop()
            del last[depth:], back[depth:]
            if depth:
                token, start = self._last(tail, depth, last, self.inner, self.inner_lengths)
                last.append(token)
                back.append(start)
            else:
                last.append(0)
                back.append(0)
            for ch, below in node.items():
                if ch:
                    stack.append(((tail + ch)[-self.longest:], depth + 1, below))
                    continue
                for w in below:
                    token, at = self._last((tail + w[-1])[-self.longest:], depth + 1, last, self.final, self.final_lengths)
                    found = [token]
                    while at:
                        found.append(last[at])
                        at = back[at]
                    found.reverse()
                    out[w] = found

    def pieces(self, chunk: str) -> list[str]:
        """The words of a normalised chunk without white space, as byte symbols."""
        end = chunk[-1]
        if chunk.isalpha():
            found = [chunk]
        elif chunk[:-1].isalpha() and end.isascii() and not end.isalnum():
            found = [chunk[:-1], end]
        else:
            found = self.pattern.findall(chunk)
        if chunk.isascii() and chunk.isprintable():
            return found
        return [p.encode().decode("latin-1").translate(self.symbol_table) for p in found]

    def encode_chunks(self, chunks) -> dict[str, list[int]]:
        split = {c: self.pieces(c) for c in chunks}
        known = self.encode_words({p for ps in split.values() for p in ps})
        return {c: [i for p in ps for i in known[p]] for c, ps in split.items()}

    def encode(self, text: str) -> list[int]:
        out: list[int] = []
        for part, special in self.segments(text):
            if special:
                out.append(self.special[part])
            else:
                chunks = split_chunks(part)
                known = self.encode_chunks(set(chunks))
                out += [i for c in chunks for i in known[c]]
        return out

    def segments(self, text: str) -> list[tuple[str, bool]]:
        if self.special_pattern is None or "<|" not in text:
            return [(text, False)]
        return [(p, p in self.special) for p in self.special_pattern.split(text) if p]

    def decode(self, ids) -> str:
        """Tokens joined by blanks: the vocabulary names no decoder."""
        return " ".join([self.names[i] for i in ids])


def cut_white(text: str) -> list[str]:
    """The parts of a text between the vocabulary's white space."""
    return text.split() if _SEPARATORS.search(text) is None else _CHUNK.findall(text)


def split_chunks(text: str) -> list[str]:
    """Normalise (composed form, lower case) and cut at white space."""
    if not text.isascii():
        text = unicodedata.normalize("NFC", text).replace("Σ", "σ")
    return cut_white(text.lower())


_MODELS: dict[int, WordBPE] = {}


def model_of(spec: str) -> WordBPE:
    """The model of a vocabulary file's text; kept in the worker."""
    key = hash(spec)
    if key not in _MODELS:
        _MODELS[key] = WordBPE(json.loads(spec))
    return _MODELS[key]


_CACHES: dict[int, tuple[dict[str, bytes], dict[str, bytes], dict[str, tuple[bytes, bytes]]]] = {}


def encode_documents(docs: DataFrame, spec_path: str, keep: list[str] | None = None) -> DataFrame:
    """Columns ``keep`` (default doc_id) of every row, n_tokens, ids_sha256 and decoded_sha256.

    Null text counts as empty: no tokens, hashes of the empty string.  Special tokens in a text are recognised.
    Repeated rows give repeated results; columns that are not kept are not read, so they may have any name; an empty
    table gives an empty result.
    """
    with open(spec_path, encoding="utf-8") as f:  # on the driver; the fixed-size vocabulary goes out as broadcast
        spec = docs.sparkSession.sparkContext.broadcast(f.read())

    def make():
        model = model_of(spec.value)
        ids_of, text_of, words = _CACHES.setdefault(id(model), ({}, {}, {}))
        special = {t: str(i).encode() for t, i in model.special.items()}

        def learn(chunks):
            if len(ids_of) > CHUNK_CACHE:
                ids_of.clear()
                text_of.clear()
            if len(words) > WORD_CACHE:
                words.clear()
            split = {c: model.pieces(c) for c in chunks.difference(ids_of)}
            new = set().union(*split.values()).difference(words)
            for w, ids in model.encode_words(new).items():
                words[w] = (" ".join(map(str, ids)).encode(), model.decode(ids).encode())
            for c, ws in split.items():
                if len(ws) == 1:
                    ids_of[c], text_of[c] = words[ws[0]]
                else:
                    both = [words[w] for w in ws]
                    ids_of[c], text_of[c] = b" ".join([b[0] for b in both]), b" ".join([b[1] for b in both])
            for w in new:
                if len(w) > KEEP_CHARS:
                    del words[w]
            return [c for c in split if len(c) > KEEP_CHARS]

        def joined(row, known, own):
            """All parts of a text, special tokens by ``own``."""
            parts = [own(p) if s else b" ".join(map(known.__getitem__, p)) for p, s in row]
            return parts[0] if len(parts) == 1 else b" ".join(filter(None, parts))

        def score(texts):
            parts = [[(p if s else split_chunks(p), s) for p, s in model.segments(t or "")] for t in texts]
            long = learn(set().union(*[p for row in parts for p, s in row if not s]))
            gc.freeze()  # what the caches hold has no cycles; collections need not walk through it
            counts, ids_hash, text_hash = [], [], []
            for row in parts:
                ids = joined(row, ids_of, special.__getitem__)
                counts.append(ids.count(b" ") + 1 if ids else 0)
                ids_hash.append(hashlib.sha256(ids).hexdigest())
                text_hash.append(hashlib.sha256(joined(row, text_of, str.encode)).hexdigest())
            for c in long:
                del ids_of[c], text_of[c]
            return [counts, ids_hash, text_hash]

        return score

    return map_texts(docs, keep or ["doc_id"], "n_tokens long, ids_sha256 string, decoded_sha256 string", make,
                     GROUP_CHARS)
