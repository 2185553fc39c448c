"""BPE encoding and decoding by forced-boundary splitting.

A merge only ever makes a token of the vocabulary. So where two adjacent bytes stand side by side inside no token at all, no merge crosses
them in any text: the place is a certain cut, and what lies between cuts can be encoded alone. White space and the
changes between letters, digits and other signs are cuts by the tokenizer's own splitting rule; inside the pieces that
are left, the byte pairs found in no token cut further. Short fragments are remembered for the time of a task and
the ids of a text are those of its fragments in order.

Splitting, merges, word ends and added tokens are read from the tokenizer's JSON file.
"""

from __future__ import annotations

import functools
import heapq
import json
import re
import string
import struct
import unicodedata

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .common import slices, small_batches


#: Letters and digits that came after Unicode 16.0, which the tokenizers library follows; to it they are other signs.
NEWER = """558 58b-58c 88f c5c cdc 208f 209d-209f a7ce-a7cf a7d2 a7d4 a7dd a7e2 a7f1 ab6c-ab6d 107bb-107bf 10940-10959 10ec5-10ec7
10ed9-10eee 11b0a 11db0-11ddb 11de0-11de9 11df1 1246f 12475-1247f 12550-12686 16ea0-16eb8 16ebb-16ed3 16ff2-16ff6 187f8-187ff
18cd6-18cda 18d09-18d20 18d80-18df2 18e00-19191 191a0-191d2 1b123-1b128 1b168 1d6a6 1df1f-1df24 1df2b-1df81 1df90-1df96
1dfcd-1dfff 1e6c0-1e6de 1e6e0-1e6e2 1e6e4-1e6e5 1e6e7-1e6ed 1e6f0-1e6f4 1e6fe-1e6ff 2b73a-2b73f 2b81e 2cea2-2cead 323b0-33479
3d000-3fc3f"""


#: Combining marks that are younger than the tokenizers library's table of marks; it doesn't put them in order.
MARKS = """7fd 898-89f 8ca-8d3 9fe c3c d3b-d3c eba 1715 1abf-1ace 1df6-1dfa a82c 10d24-10d27 10eab-10eac 10efd-10eff 10f46-10f50 10f82-10f85
11070 1133b 1145e 11839-1183a 1193d-1193e 11943 119e0 11a34 11a47 11a99 11d42 11d44-11d45 11d97 11f41-11f42 16ff0-16ff1 1e08f
1e130-1e136 1e2ae 1e2ec-1e2ef 1e4ec-1e4ef"""
#: Capitals that came after Unicode 15.1, Python's tables, and their small letters, which the tokenizers library knows.
LOWER = {0x1C89: 0x1C8A, 0xA7CB: 0x264, 0xA7CC: 0xA7CD, 0xA7CE: 0xA7CF, 0xA7D2: 0xA7D3, 0xA7D4: 0xA7D5, 0xA7DA: 0xA7DB, 0xA7DC: 0x19B}
LOWER |= {c: c + 0x20 for c in range(0x10D50, 0x10D66)} | {c: c + 0x1B for c in range(0x16EA0, 0x16EB9)}


def _one_of(spans: str) -> str:
    """Pattern of one character out of spans of code points."""
    both = [x.split("-") for x in spans.split()]
    return "[" + "".join(f"{chr(int(x[0], 16))}-{chr(int(x[-1], 16))}" for x in both) + "]"


def byte_letters() -> list[str]:
    """The letter that stands for each byte in byte-level vocabularies: printable bytes for themselves, the others by code points from 256 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    letters = {b: chr(b) for b in plain}
    for n, b in enumerate(b for b in range(256) if b not in letters):
        letters[b] = chr(256 + n)
    return [letters[b] for b in range(256)]


class Vocabulary:
    """What the file says, in the form that encoding needs. The letters' normalisation (NFC, white space, lower case) is that of the files with this splitting rule."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        self.end = model.get("end_of_word_suffix") or ""
        self.ids: dict[str, int] = model["vocab"]
        self.rank = {tuple(m if isinstance(m, list) else m.split(" ")): n for n, m in enumerate(model["merges"])}
        self.added = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.letters = byte_letters()
        self.pattern = spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"]
        self.inside = set()
        for token in self.ids:
            body = token[: len(token) - len(self.end)] if self.end and token.endswith(self.end) else token
            self.inside.update(zip(body, body[1:], strict=False))
        #: finds a cut between small letters; words of small letters are most of a text
        self.letter_cut = re.compile("|".join(a + b for a in string.ascii_lowercase for b in string.ascii_lowercase if (a, b) not in self.inside) or "(?!)").search


@functools.lru_cache(maxsize=1)
def token_names(path: str) -> list[str]:
    """Name of each id."""
    v = vocabulary(path)
    names = {i: s for s, i in [*v.ids.items(), *v.added.items()]}
    return [names.get(i, "") for i in range(max(names) + 1)]


@functools.lru_cache(maxsize=1)
def vocabulary(path: str) -> Vocabulary:
    """One a Python worker: its size is the file's."""
    return Vocabulary(path)


class Memo(dict):
    """key -> make(key) for short keys, remembered in two generations of at most `limit` each: when the younger is full it becomes the older, so what keeps
    coming back stays."""

    def __init__(self, make, limit: int):
        super().__init__()
        self.make, self.limit, self.older = make, limit, {}

    def __missing__(self, key: str) -> bytes:
        if (value := self.older.get(key)) is None:
            value = self.make(key)
        if len(key) <= 64:
            if len(self) >= self.limit:
                self.older = dict(self)
                self.clear()
            self[key] = value
        return value


class Encoder:
    """Encodes texts; keeps the ids of pieces it has met, up to 2 * `limit` short ones (some 200 MB at the most), for the time of a task."""

    #: Texts of letters below this code point are cut into pieces by sets of characters, others by Unicode properties.
    NEAR = 0x250

    def __init__(self, vocabulary: Vocabulary, limit: int = 500_000):
        import regex

        self.v, self.none = vocabulary, len(vocabulary.rank)
        self.pattern = regex.compile(vocabulary.pattern)
        self.newer, self.marks = re.compile(_one_of(NEWER)), re.compile(f"({_one_of(MARKS)})")
        self.capital = regex.compile("[" + "".join(map(chr, LOWER)) + "]").search
        self.special = regex.compile("(" + "|".join(regex.escape(x) for x in sorted(vocabulary.added, key=len, reverse=True)) + ")") if vocabulary.added else None
        # the same pattern with its properties written out for near characters
        near = vocabulary.pattern
        for name in (r"\s", r"\p{L}", r"\p{N}"):
            match = regex.compile(name).fullmatch
            near = near.replace(name, "".join(re.escape(chr(c)) for c in range(self.NEAR) if match(chr(c))))
        self.near, self.far = re.compile(near).findall, re.compile(f"[^\\x00-{chr(self.NEAR - 1)}]").search
        self.words = Memo(self.word, limit)

    def merged(self, letters: str, last: bool) -> list[int]:
        """Ids of one fragment: the leftmost of the lowest-ranked adjacent pairs is merged until none has a rank."""
        parts = list(letters)
        if last:
            parts[-1] += self.v.end
        if len(parts) > 100:
            parts = self._merged_long(parts)
        else:
            rank, none = self.v.rank.get, self.none
            ranks = [rank(p, none) for p in zip(parts, parts[1:])]  # noqa: B905
            while ranks:
                best = min(ranks)
                if best == none:
                    break
                k = ranks.index(best)
                merged = parts[k] = parts[k] + parts.pop(k + 1)
                del ranks[k]
                if k < len(ranks):
                    ranks[k] = rank((merged, parts[k + 1]), none)
                if k:
                    ranks[k - 1] = rank((parts[k - 1], merged), none)
        ids = self.v.ids
        return [ids[p] for p in parts]

    def _merged_long(self, parts: list) -> list[str]:
        """The same merges in n log n steps: a heap of pairs (rank, place) over a linked list. A pair that has changed since it was put on the heap is passed over."""
        rank, n = self.v.rank.get, len(parts)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(r, k) for k in range(n - 1) if (r := rank((parts[k], parts[k + 1]))) is not None]
        heapq.heapify(heap)
        while heap:
            r, k = heapq.heappop(heap)
            if parts[k] is None or (m := after[k]) >= n or rank((parts[k], parts[m])) != r:
                continue
            parts[k] += parts[m]
            parts[m] = None
            after[k] = m = after[m]
            if m < n:
                before[m] = k
                if (r := rank((parts[k], parts[m]))) is not None:
                    heapq.heappush(heap, (r, k))
            if (b := before[k]) >= 0 and (r := rank((parts[b], parts[k]))) is not None:
                heapq.heappush(heap, (r, b))
        return [p for p in parts if p is not None]

    def word(self, piece: str) -> bytes:
        """Ids (packed) of one piece: cut at byte pairs that stand in no token, each fragment alone."""
        plain = piece.isascii()
        if plain and piece.isalpha() and piece.islower() and not self.v.letter_cut(piece):
            ids = self.merged(piece, True)
            return struct.pack(f"<{len(ids)}I", *ids)
        letters = piece if plain and piece.isprintable() else "".join([self.v.letters[b] for b in piece.encode("utf-8")])
        inside, end = self.v.inside, len(letters)
        cut = [k for k, pair in enumerate(zip(letters, letters[1:], strict=False), 1) if pair not in inside]
        if not cut:
            ids = self.merged(letters, True)
        else:
            cut = [0, *cut, end]
            ids = [i for lo, hi in zip(cut, cut[1:], strict=False) for i in self.merged(letters[lo:hi], hi == end)]
        return struct.pack(f"<{len(ids)}I", *ids)

    def pieces(self, text: str) -> list[str]:
        """Pieces by the tokenizer's rule."""
        if not self.far(text):
            return self.near(text)
        if not self.newer.search(text):
            return self.pattern.findall(text)
        plain = self.newer.sub("\ufffc", text)
        return [text[m.start() : m.end()] for m in self.pattern.finditer(plain)]

    def composed(self, text: str) -> str:
        """NFC as the library has it: younger marks stay where they are."""
        if self.far(text) and self.marks.search(text):
            return "".join([unicodedata.normalize("NFC", x) for x in self.marks.split(text)])
        return unicodedata.normalize("NFC", text)

    def plain(self, text: str) -> bytes:
        """Ids (packed) of a text without added tokens."""
        if text.isascii():
            text = text.lower()
        else:
            # lower case letter by letter: a capital sigma has no final form here
            text = self.composed(text).replace("Σ", "σ").lower()
            text = text.translate(LOWER) if self.capital(text) else text
        return b"".join(map(self.words.__getitem__, self.pieces(text)))

    def encode(self, text: str) -> bytes:
        """Ids of a text as little-endian unsigned 32-bit integers. Strings of added tokens are those tokens."""
        if self.special is None or not any(x in text for x in self.v.added):
            return self.plain(text)
        parts = self.special.split(text)
        return b"".join(self.v.added[x].to_bytes(4, "little") if k % 2 else self.plain(x) for k, x in enumerate(parts))


def encode_texts(docs: DataFrame, tokenizer: str, text_col: str = "text", decoded: bool = False) -> DataFrame:
    """docs with token_ids (packed little-endian unsigned 32-bit integers) and n_tokens, of whole texts; with `decoded`, also what decode_ids makes of the ids.

    A null or empty text has no tokens. Each row stands alone, so repeated rows, null ids and other columns don't matter; input columns of the
    new names are replaced. An empty table gives an empty result.
    """
    new = [T.StructField("token_ids", T.BinaryType()), T.StructField("n_tokens", T.LongType())] + [T.StructField("decoded", T.StringType())] * decoded
    docs = docs.drop(*(f.name for f in new))
    schema = T.StructType([*docs.schema.fields, *new])

    def run(batches):
        encode, decode = Encoder(vocabulary(tokenizer)).encode, decoder(tokenizer)
        for whole in batches:
            for batch in slices(whole, text_col, 1_000_000):
                ids = [encode(t) if (t := x.as_py()) else b"" for x in batch.column(text_col)]
                columns = [pa.array(ids, pa.binary()), pa.array([len(x) // 4 for x in ids], pa.int64())]
                if decoded:
                    columns.append(pa.array(map(decode, ids), pa.string()))
                yield pa.RecordBatch.from_arrays([*batch.columns, *columns], schema.fieldNames())

    return small_batches(docs).mapInArrow(run, schema)


def decoder(tokenizer: str):
    """Function from packed ids to text: names of the tokens, joined by one space as the file has no decoder."""
    import numpy as np

    name = np.array(token_names(tokenizer), object)
    return lambda ids: " ".join(name[np.frombuffer(ids, "<u4")].tolist())


def decode_ids(encoded: DataFrame, tokenizer: str) -> DataFrame:
    """encoded (with token_ids) and decoded: the text of the ids; '' for none, null for null."""
    encoded = encoded.drop("decoded")
    schema = T.StructType([*encoded.schema.fields, T.StructField("decoded", T.StringType())])

    def run(batches):
        decode = decoder(tokenizer)
        for whole in batches:
            for batch in slices(whole, "token_ids", 1_000_000):
                texts = [None if (b := x.as_py()) is None else decode(b) for x in batch.column("token_ids")]
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string())], schema.fieldNames())

    return small_batches(encoded).mapInArrow(run, schema)
