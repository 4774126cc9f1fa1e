"""Byte-level BPE by traversal of a prefix-sharing trie."""

from __future__ import annotations

import functools
import hashlib
import json
from collections.abc import Iterator

import pyarrow as pa
import regex
from pyspark.sql import DataFrame

VOCABULARY = "byte_bpe_50k.json"
#: Words whose encodings a task holds before it starts a new table; a word that comes again is then encoded again.
KNOWN_WORDS = 400_000
#: Bytes of words whose encodings a task holds at most.
KNOWN_BYTES = 32_000_000

# The split pattern of the vocabulary, with white space written out (White_Space of Unicode).
_SPACE = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
PATTERN = rf"'s|'t|'re|'ve|'m|'ll|'d| ?\p{{L}}+| ?\p{{N}}+| ?[^{_SPACE}\p{{L}}\p{{N}}]+|[{_SPACE}]+(?![^{_SPACE}])|[{_SPACE}]+"


def _byte_of_letter() -> dict[str, int]:
    """Byte-level vocabularies write a printable byte as itself and the others as letters from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    letters = {chr(b): b for b in plain}
    for i, b in enumerate(b for b in range(256) if b not in set(plain)):
        letters[chr(256 + i)] = b
    return letters


class Vocabulary:
    """Tokens as bytes, the rank of each merge, and a trie of the tokens read backwards."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        letters = _byte_of_letter()
        ids = spec["model"]["vocab"]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        as_bytes = {i: bytes(letters[c] for c in word) for word, i in ids.items() if word not in self.special}
        self.bytes_of = as_bytes | {i: s.encode() for s, i in self.special.items()}
        #: rank[(left, right)], and for each token made by a merge: its rank and parts.  Single bytes have rank -1.
        self.rank: dict[tuple[int, int], int] = {}
        self.made = {i: (-1, -1, -1) for i in as_bytes}
        for r, pair in enumerate(spec["model"]["merges"]):
            left, right = pair if isinstance(pair, list) else pair.split(" ")
            a, b, whole = ids[left], ids[right], ids[left + right]
            self.rank[a, b] = r
            self.made[whole] = (r, a, b)
        self.backwards: dict[int, int] = {}
        self.ends: dict[int, int] = {}
        nodes = 1
        for i, word in as_bytes.items():
            if not self.whole(i):
                continue
            node = 0
            for byte in reversed(word):
                after = self.backwards.get(node << 8 | byte)
                if after is None:
                    after = self.backwards[node << 8 | byte] = nodes
                    nodes += 1
                node = after
            self.ends[node] = i
        self.length = {i: len(w) for i, w in as_bytes.items()}
        self._stand: dict[tuple[int, int], bool] = {}

    def stand_apart(self, left: int, right: int) -> bool:
        """Whether two tokens that are encodings of their own stay two tokens when they follow each other."""
        known = self._stand.get((left, right))
        if known is None:
            if len(self._stand) > 1_000_000:
                self._stand.clear()
            known = self._stand[left, right] = self._uncrossed(left, right, len(self.rank))
        return known

    def _uncrossed(self, a: int, b: int, due: int) -> bool:
        """Whether no merge crosses the border of a and b before rank ``due``.

        Undo the merges of the left token's right edge and the right token's left edge, latest first.  The pair that faces
        each other exists between the later of its two births and the earlier of the two merges that end it; were its
        own merge due in that time, the border would be crossed.  At equal rank the merge further left goes first.
        """
        end_a = end_b = due
        while True:
            r = self.rank.get((a, b))
            if r is not None and r < end_a and r <= end_b and r < due:
                return False
            born_a, born_b = self.made[a][0], self.made[b][0]
            if born_a < 0 and born_b < 0:
                return True
            if born_a > born_b:
                end_a, a = born_a, self.made[a][2]
            else:
                end_b, b = born_b, self.made[b][1]

    def whole(self, token: int) -> bool:
        """Whether the token is the encoding of its own bytes."""
        due, a, b = self.made[token]
        return due < 0 or (self.whole(a) and self.whole(b) and self._uncrossed(a, b, due))

    def last_token(self, word: bytes, end: int, last: list[int]) -> int:
        """The last token of the encoding of word[:end], given the last tokens of all shorter prefixes.

        It is the one token that ends there and stands apart from the last token of the prefix that it leaves.
        """
        backwards, ends, node, at = self.backwards, self.ends, 0, end
        while at > 0:
            node = backwards.get(node << 8 | word[at - 1], -1)
            if node < 0:
                break
            at -= 1
            token = ends.get(node, -1)
            if token >= 0 and (at == 0 or self.stand_apart(last[at], token)):
                return token
        raise ValueError("the vocabulary has no token for a byte")


class Trie:
    """A trie of words with chains of single children kept as one edge: [label, children by first byte, is a word]."""

    def __init__(self) -> None:
        self.root: list = [b"", {}, False]

    def insert(self, word: bytes) -> None:
        node, at = self.root, 0
        while at < len(word):
            child = node[1].get(word[at])
            if child is None:
                node[1][word[at]] = [word[at:], {}, True]
                return
            label = child[0]
            same = len(label)
            if word[at:at + same] != label:
                low = 1  # the first byte is the same
                while low < len(label) and at + low < len(word) and label[low] == word[at + low]:
                    low += 1
                upper = [label[:low], {label[low]: [label[low:], child[1], child[2]]}, False]
                node[1][word[at]] = upper
                child, same = upper, low
            node, at = child, at + same
        node[2] = True


def encode_words(vocabulary: Vocabulary, words: set[bytes]) -> dict[bytes, list[int]]:
    """The encodings of distinct words: one state per trie node, found once however many words share the prefix.

    The traversal keeps the path's bytes and the last token of each prefix on it; a word's tokens are read off by
    stepping back over the path.
    """
    trie = Trie()
    for word in words:
        if word:
            trie.insert(word)
    found: dict[bytes, list[int]] = {}
    path, last = bytearray(), [-1]
    stack = [(child, 0) for child in trie.root[1].values()]
    while stack:
        (label, children, is_word), depth = stack.pop()
        del path[depth:], last[depth + 1:]
        for byte in label:
            path.append(byte)
            last.append(vocabulary.last_token(path, len(path), last))
        if is_word:
            tokens, at = [], len(path)
            while at:
                tokens.append(last[at])
                at -= vocabulary.length[last[at]]
            found[bytes(path)] = tokens[::-1]
        stack.extend((child, len(path)) for child in children.values())
    return found


class Places(dict):
    """A running number for each word, given at its first look-up."""

    def __init__(self) -> None:
        super().__init__()
        self.new: list[str] = []

    def __missing__(self, word: str) -> int:
        self.new.append(word)
        self[word] = place = len(self)
        return place


class Coder:
    """Encodes and decodes texts; keeps the encodings of words already met, up to a bound."""

    def __init__(self, path: str):
        self.vocabulary = Vocabulary(path)
        self.split = regex.compile(PATTERN)
        marks = sorted(self.vocabulary.special, key=len, reverse=True)
        self.special = regex.compile("(" + "|".join(map(regex.escape, marks)) + ")") if marks else None
        self.forget()

    def forget(self) -> None:
        self.places = Places()
        self.ids: list[str] = []
        self.decoded: list[bytes] = []
        self.held = 0

    def pieces(self, text: str) -> list[str]:
        """Words in order; special tokens are words of their own."""
        if self.special is None or not self.special.search(text):
            return self.split.findall(text)
        out: list[str] = []
        for part in self.special.split(text):
            out.extend([part] if part in self.vocabulary.special else self.split.findall(part))
        return out

    def places_of(self, texts: list[str]) -> list[list[int]]:
        """For each text the numbers of its words; words met for the first time are encoded in one trie."""
        if len(self.ids) > KNOWN_WORDS or self.held > KNOWN_BYTES:
            self.forget()
        found = [list(map(self.places.__getitem__, self.pieces(text))) for text in texts]
        new, self.places.new = self.places.new, []
        special = self.vocabulary.special
        codes = encode_words(self.vocabulary, {w.encode() for w in new if w not in special})
        for word in new:
            tokens = [special[word]] if word in special else codes[word.encode()]
            self.ids.append(",".join(map(str, tokens)))
            self.decoded.append(b"".join([self.vocabulary.bytes_of[t] for t in tokens]))
            self.held += len(self.ids[-1]) + 2 * len(word)
        return found

    def digest(self, places: list[int]) -> tuple[int, str, str]:
        """Number of tokens, digest of the ids, digest of the decoded text."""
        ids, decoded = self.ids, self.decoded
        listed = ",".join([ids[i] for i in places])
        text = b"".join([decoded[i] for i in places]).decode("utf-8", "replace")
        return listed.count(",") + bool(places), hashlib.sha256(listed.encode()).hexdigest(), hashlib.sha256(text.encode()).hexdigest()

    def encode(self, text: str) -> list[int]:
        return [int(i) for at in self.places_of([text])[0] for i in self.ids[at].split(",")]

    def decode(self, ids: list[int]) -> str:
        return b"".join([self.vocabulary.bytes_of[i] for i in ids]).decode("utf-8", "replace")


@functools.lru_cache(2)
def coder_of(path: str) -> Coder:
    """One coder for all tasks of a worker."""
    return Coder(path)


def groups(texts: list[str | None], most: int = 2_000_000) -> Iterator[list[str]]:
    """Runs of texts whose words go into one trie: at least one text, up to so many characters."""
    run: list[str] = []
    size = 0
    for text in texts:
        text = text or ""
        if run and size + len(text) > most:
            yield run
            run, size = [], 0
        run.append(text)
        size += len(text)
    if run:
        yield run


def encode_digests(docs: DataFrame, path: str) -> DataFrame:
    """Per row of docs: doc_id, n_tokens, ids_sha256, decoded_sha256.

    The whole text is encoded as the vocabulary file says, special tokens in the text included, and decoded again.  Null
    and empty texts have 0 tokens and the digests of the empty string.  Repeated rows give repeated rows, no rows none.  There
    is no shuffle; a task holds one run of texts, its trie and the encodings of at most KNOWN_WORDS words.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = coder_of(path)
        for batch in batches:
            out: list[tuple[int, str, str]] = []
            for texts in groups(batch.column(1).to_pylist()):
                out.extend(map(coder.digest, coder.places_of(texts)))
            n, ids, decoded = zip(*out, strict=True) if out else ((), (), ())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(ids, pa.string()), pa.array(decoded, pa.string())], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    kind = dict(docs.dtypes)["doc_id"]
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, n_tokens bigint, ids_sha256 string, decoded_sha256 string")


def encode_ids(docs: DataFrame, path: str) -> DataFrame:
    """doc_id and the token ids themselves."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = coder_of(path)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([coder.encode(t or "") for t in batch.column(1).to_pylist()], pa.list_(pa.int32()))], ["doc_id", "ids"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {dict(docs.dtypes)['doc_id']}, ids array<int>")


def vocabulary_path(name: str = VOCABULARY) -> str:
    import public_tokenizers

    return str(public_tokenizers.path(name))
