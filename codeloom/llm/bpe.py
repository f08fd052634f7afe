"""BPE encoding by one depth-first walk over the trie of a batch's distinct words.

BPE has a prefix property: of every prefix of a word, exactly one vocabulary entry is the last token of its encoding, and
an entry is that token if it may follow the last token of what is left of it (if merging both leaves the two as they are).
A word's encoding is thus a chain of last-token states along its path in the trie, and words that share a prefix share
these states. Sorted words are the trie in depth-first order; the path kept from one word to the next is their common
prefix, so each trie node's state is computed once.

Where only ids are wanted and no way to encode is named (packing, counting), the library's own model spells each distinct
word instead; splitting, known words and joining are the same.
"""

from __future__ import annotations

import json
import unicodedata
from codecs import charmap_decode
from collections.abc import Callable, Iterable
from functools import cache
from itertools import filterfalse, pairwise
from os.path import commonprefix

import regex
import tokenizers

from codeloom.llm.common import uncollected

#: The white space of the vocabulary's normalizer, and its pre-tokenizer's pattern.
WHITE = "\t-\r \x85\xa0  -     　"
PATTERN = rf"'s|'t|'re|'ve|'m|'ll|'d|[\p{{L}}]+|[\p{{N}}]|[^{WHITE}\p{{L}}\p{{N}}]+"
END = "</w>"
#: Words whose encodings a worker keeps from batch to batch (some 250 bytes each).
KNOWN = 800_000


def byte_letters() -> list[str]:
    """The printable letter that stands for each byte in byte-level vocabularies."""
    kept = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    table, spare = [""] * 256, 256
    for b in range(256):
        table[b], spare = (chr(b), spare) if b in kept else (chr(spare), spare + 1)
    return table


class Known(dict):
    """Results of a function by its argument. After age() they are the older ones, of which those that are asked for again return."""

    def __init__(self, found: Callable):
        super().__init__()
        self.found, self.older = found, {}

    def __missing__(self, x):
        value = self.older.get(x)
        self[x] = value = self.found(x) if value is None else value
        return value

    def age(self) -> None:
        self.older = dict(self)
        self.clear()


class Trie:
    """Encoder for one vocabulary file (a tokenizers JSON file of the BPE kind with word ends).

    encode() equals the library's encode(text, add_special_tokens=False).ids, and decode() its decode of all ids.
    limit bounds the words kept between batches; with by_model the library's model spells the words, without decoded
    texts. Results depend on neither.
    """

    def __init__(self, path: str, limit: int | None = None, by_model: bool = False):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.vocab: dict[str, int] = spec["model"]["vocab"]
        self.rank = {tuple(m) if isinstance(m, list) else tuple(m.split(" ")): i for i, m in enumerate(spec["model"]["merges"])}
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.names = {i: t for t, i in self.vocab.items()} | {i: t for t, i in self.special.items()}
        self.shown = {i: t.encode() for i, t in self.names.items()}
        self.packed = {i: i.to_bytes(4, "little") for i in self.names}
        self.reach: tuple[dict[str, int], dict[str, int]] = ({}, {})  # by the last four letters: the longest token with this end, inside and at the end of a word
        for t in self.vocab:
            ends = t.endswith(END) and t != END
            body = t[: -len(END)] if ends else t
            if len(body) > 3:
                self.reach[ends][body[-4:]] = max(len(body), self.reach[ends].get(body[-4:], 0))
        self.letters = byte_letters()
        self.letters = "".join(self.letters)
        self.find = regex.compile(PATTERN).findall
        self.odd = regex.compile("|".join(map(regex.escape, sorted(self.special, key=len, reverse=True)))) if self.special else None
        self.blank = regex.compile(f"[{WHITE}]+")
        self.limit, self.known = limit or KNOWN, Known(self.ids)
        self.model = tokenizers.Tokenizer.from_file(path).model if by_model else None
        self.after: dict[str, dict[str, str | bytes]] = {}  # by the last token: which tokens may follow, with their packed ids (else nothing); under "" the last token itself

    def merged(self, symbols: list[str]) -> list[str]:
        """Plain BPE: apply the merge of least rank, leftmost first, until none applies."""
        get, none = self.rank.get, 1 << 60
        ranks = [get(pair, none) for pair in pairwise(symbols)]
        while ranks and (least := min(ranks)) < none:
            i = ranks.index(least)
            symbols[i : i + 2] = [symbols[i] + symbols[i + 1]]
            del ranks[i]
            if i:
                ranks[i - 1] = get((symbols[i - 1], symbols[i]), none)
            if i < len(ranks):
                ranks[i] = get((symbols[i], symbols[i + 1]), none)
        return symbols

    def symbols(self, token: str) -> list[str]:
        return [*token[: -len(END) - 1], token[-len(END) - 1 :]] if token.endswith(END) and len(token) > len(END) else list(token)

    def follows(self, table: dict, right: str) -> bytes:
        """The packed id of right if it may come after the last token that table is for, else nothing; no last token is the start of the word."""
        left = table[""]
        fits = self.merged([*left, *self.symbols(right)]) == [x for x in (left, right) if x]
        found = table[right] = self.packed[self.vocab[right]] if fits else b""
        return found

    def walk(self, words: Iterable[str]) -> dict[str, bytes]:
        """Packed ids of each word (in byte letters), along the trie in depth-first order."""
        if sum(map(len, self.after.values())) > 600_000:
            self.after.clear()
        out, path, vocab, after, follows = {}, "", self.vocab, self.after, self.follows
        inner, final = self.reach[0].get, self.reach[1].get
        tables, spelled = [after.setdefault("", {"": ""})], [b""]  # of each prefix of path: what may follow its last token, and its ids
        for word in sorted(words):
            n = len(word)
            keep = min(len(commonprefix((path, word))), n - 1) + 1
            path = word[: n - 1]
            del tables[keep:], spelled[keep:]
            for i in range(keep, n):  # states of the inner nodes that are new
                for j in range(max(0, i - inner(word[i - 4 : i], 3)) if i > 3 else 0, i):
                    if (token := word[j:i]) in vocab and (table := tables[j]) is not None:
                        found = table.get(token)
                        if found or found is None and (found := follows(table, token)):
                            tables.append(after.get(token) or after.setdefault(token, {"": token}))
                            spelled.append(spelled[j] + found)
                            break
                else:
                    tables.append(None)
                    spelled.append(None)
            for j in range(max(0, n - final(word[n - 4 :], 3)) if n > 3 else 0, n):
                token = word[j:] + END
                if token in vocab and (table := tables[j]) is not None:
                    found = table.get(token)
                    if found or found is None and (found := follows(table, token)):
                        break
            else:
                raise ValueError(f"the vocabulary can't spell {word!r}")
            out[word] = spelled[j] + found
        return out

    def chunks(self, text: str) -> list[str | int]:
        """What is between white space, normalized; ids stand for special tokens."""
        if self.odd and "<|" in text and self.odd.search(text):
            out, at = [], 0
            for m in self.odd.finditer(text):
                out += [*self.plain(text[at : m.start()]), self.special[m[0]]]
                at = m.end()
            return [*out, *self.plain(text[at:])]
        return self.plain(text)

    def plain(self, text: str) -> list[str]:
        if text.isascii():
            text = text.lower()
        else:
            if not unicodedata.is_normalized("NFC", text):
                text = unicodedata.normalize("NFC", text)
            text = text.replace("Σ", "σ").lower()
        if "\x1c" in text or "\x1d" in text or "\x1e" in text or "\x1f" in text:
            return [x for x in self.blank.split(text) if x]
        return text.split()

    def lettered(self, piece: str) -> str:
        return piece if piece.isascii() and piece.isprintable() else charmap_decode(piece.encode(), "strict", self.letters)[0]

    def pieces(self, chunk: str) -> Iterable[str]:
        if chunk.isalpha():
            return (chunk,)
        return (chunk[:-1], chunk[-1]) if chunk[-1] in ",.;:!?" and chunk[:-1].isalpha() else self.find(chunk)

    def ids(self, chunk: str | int) -> bytes:
        """The packed ids of a chunk that is not known yet."""
        if isinstance(chunk, int):
            return self.packed[chunk]
        pieces = self.pieces(chunk)
        if len(pieces) != 1 or pieces[0] != chunk:
            return b"".join([self.known[p] for p in pieces])
        if self.model:
            return b"".join([self.packed[t.id] for t in self.model.tokenize(self.lettered(chunk))])
        return self.walk([self.lettered(chunk)])[self.lettered(chunk)]

    def learn(self, chunks: Iterable[str | int]) -> None:
        """Encode all pieces of chunks that are not known yet in one walk."""
        alone = {p for c in filterfalse(self.known.older.__contains__, chunks) if isinstance(c, str) for p in self.pieces(c)}
        of = {self.lettered(p): p for p in alone if p not in self.known and p not in self.known.older}
        for word, ids in self.walk(of).items():
            self.known[of[word]] = ids

    def encode_batch(self, texts: list[str], show: bool = False) -> list[tuple[bytes, bytes]]:
        """For each text: its ids as little-endian unsigned 32-bit integers, and (if show) the decoded text in UTF-8."""
        with uncollected():
            return self._encode(texts, show)

    def _encode(self, texts: list[str], show: bool) -> list[tuple[bytes, bytes]]:
        # a text's chunks are made anew wherever they are needed: that costs less than leaving the processor's cache with all of them
        known, shown = self.known, self.shown.__getitem__
        if not self.model:
            new: set[str | int] = set()
            for t in texts:
                new.update(filterfalse(known.__contains__, self.chunks(t)))
            self.learn(new)
        out = []
        for t in texts:
            ids = b"".join(map(known.__getitem__, self.chunks(t)))
            out.append((ids, b" ".join(map(shown, memoryview(ids).cast("I"))) if show else b""))
        if len(known) > self.limit // 2:
            known.age()
        return out


@cache
def trie(path: str, by_model: bool = False) -> Trie:
    """One encoder for each Python worker, vocabulary and way."""
    return Trie(path, by_model=by_model)


def vocabulary(path: str | None = None) -> str:
    if path:
        return path
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")
