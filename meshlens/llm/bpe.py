"""BPE encoding and decoding by a prefix-sharing trie.

A batch's distinct words are put into a trie. Going depth-first, each node gets the last token of the encoding of the
prefix that ends there; the encoding of a prefix is that token after the encoding of what is left of it, so what words
share is computed once. A token can be last if it ends at the node and stands validly after the last token before it: a
pair is valid if merging its symbols by the ranks gives that pair again. A node's token is the only one for which that
holds. Words end in the model's end-of-word symbol, which makes their last node a symbol of its own.

Texts are cut as the tokenizer file says: special strings, NFC, lower case by code point, the split pattern, bytes as
characters. All this is done once for each different run of non-space bytes; encodings of runs are kept from batch to
batch up to a bound, so memory doesn't grow with the input.

Defined cases: null is the empty text; a text without tokens has the digest of nothing; special strings in a text are
their own tokens; repeated rows are encoded alike. The vocabulary's path is a parameter; the file is never copied.
"""

from __future__ import annotations

import hashlib
import json
import struct
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StructType
from tokenizers import Tokenizer

from meshlens.llm.shared import ship, slices, words_of

#: Encodings of runs and words kept from batch to batch, and remembered pairs of tokens.
KEPT_RUNS, KEPT_WORDS, KEPT_PAIRS = 120_000, 80_000, 150_000
#: Bytes of text whose distinct words make one trie.
SLICE = 1 << 21
#: Trie nodes up to this depth are kept as well.
NODE_DEPTH = 4


def byte_characters() -> list[str]:
    """The printable stand-ins of bytes that byte-level tokenizers use: printable ones stay, the rest follow from 256 on."""
    stay = {*range(33, 127), *range(161, 173), *range(174, 256)}
    rest = iter(range(256, 512))
    return [chr(b if b in stay else next(rest)) for b in range(256)]


class Kept:
    """What is remembered, in two generations: the older one goes when the newer one is full; what is used moves to the newer."""

    def __init__(self, most: int) -> None:
        self.most, self.new, self.old = most, {}, {}

    def get(self, key: object) -> object:
        value = self.new.get(key)
        if value is None:
            value = self.old.get(key)
            if value is not None:
                self.new[key] = value
        return value

    def age(self) -> None:
        if len(self.new) > self.most:
            self.old, self.new = self.new, {}


def gathered(values: np.ndarray, begin: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """values[b : b + n] for each of begin and sizes, end to end."""
    ends = np.cumsum(sizes)
    return values[np.arange(ends[-1] if len(ends) else 0) + np.repeat(begin - (ends - sizes), sizes)]


class BpeModel:
    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        self.vocab: dict[str, int] = dict(model["vocab"])
        self.suffix: str = model.get("end_of_word_suffix") or ""
        pairs = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]]
        self.ranks = {p: i for i, p in enumerate(pairs)}
        self.added = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.tokens = {i: t for t, i in (self.vocab | self.added).items()}
        whole = Tokenizer.from_file(path)
        self.normalizer, self.cutter = whole.normalizer, whole.pre_tokenizer
        self.special = regex.compile("(" + "|".join(map(regex.escape, sorted(self.added, key=len, reverse=True))) + ")") if self.added else None
        split = next(p for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split")
        self.split = regex.compile(split["pattern"]["Regex"].replace(r"\s", r"\p{White_Space}"))
        self.characters = byte_characters()
        self.sizes = self._sizes()
        self.valid: dict[tuple[str, str], bool] = {}
        self.formed: dict[str, tuple[int, str, str] | None] = {}
        self.words = Kept(KEPT_WORDS)
        self.runs = Kept(KEPT_RUNS)
        self.nodes = Kept(KEPT_WORDS)
        self.spelled: tuple[np.ndarray, np.ndarray, np.ndarray] | None = None

    def _sizes(self) -> tuple[dict[str, tuple[int, ...]], dict[str, tuple[int, ...]]]:
        """For the last symbols (three, or fewer) of a prefix, and of a whole word: the lengths of the tokens that can end so, longest first."""
        found: tuple[dict[str, set[int]], dict[str, set[int]]] = ({}, {})
        for token in self.vocab:
            whole = bool(self.suffix) and token.endswith(self.suffix)
            body = token[: -len(self.suffix)] if whole else token
            found[whole].setdefault(body[-3:], set()).add(len(body))
        for table in found:
            for end in table:
                table[end] |= {n for n in range(1, len(end)) if end[-n:] in table}
        return tuple({e: tuple(sorted(n, reverse=True)) for e, n in table.items()} for table in found)

    # -- texts to words

    def pieces(self, run: bytes) -> list[str | int]:
        """Words, as characters for bytes, and ids of special strings of one run without white space."""
        text = run.decode("utf-8", "replace")
        out: list[str | int] = []
        for part in self.special.split(text) if self.special else [text]:
            out += [self.added[part]] if part in self.added else self._words(part)
        return out

    def _words(self, text: str) -> list[str]:
        """Words, as characters for bytes, of a text without special strings."""
        if not text.isascii():  # by the library's own tables of letters and numbers
            return [w for w, _ in self.cutter.pre_tokenize_str(self.normalizer.normalize_str(text))]
        if text.isprintable():
            return self.split.findall(text.lower())
        return ["".join([self.characters[b] for b in w.encode()]) for w in self.split.findall(text.lower())]

    # -- words to tokens

    def symbols(self, token: str) -> list[str]:
        if self.suffix and token.endswith(self.suffix):
            body = token[: -len(self.suffix)]
            return [*body[:-1], body[-1] + self.suffix]
        return list(token)

    def made(self, token: str) -> tuple[int, str, str] | None:
        """The last merge (rank, left, right) when a token's own symbols are merged by rank, leftmost first; rank -1 if it is one symbol, None if the merges end elsewhere."""
        if token not in self.formed:
            symbols, last = self.symbols(token), (-1, token, token)
            while len(symbols) > 1:
                rank, i = min((self.ranks.get(p, 1 << 60), i) for i, p in enumerate(zip(symbols, symbols[1:], strict=False)))
                if rank == 1 << 60:
                    break
                last = (rank, symbols[i], symbols[i + 1])
                symbols[i : i + 2] = [symbols[i] + symbols[i + 1]]
            self.formed[token] = last if len(symbols) == 1 else None
        return self.formed[token]

    def follows(self, a: str, b: str) -> bool:
        """Whether token b can stand right after token a ("": at the start).

        Goes back in time: at each moment the symbols on both sides of the border must not be the next pair to merge.
        A merge of equal rank on the left comes first, one on the right later.
        """
        found = self.valid.get((a, b))
        if found is not None:
            return found
        if len(self.valid) > KEPT_PAIRS:
            self.valid.clear()
        key, until = (a, b), 1 << 61
        found = (not a or self.made(a) is not None) and self.made(b) is not None
        while found and a:
            if self.ranks.get((a, b), 1 << 61) < until:
                found = False
                break
            (ra, _, inner_a), (rb, inner_b, _) = self.made(a), self.made(b)
            if ra < 0 and rb < 0:
                break
            if ra > rb:
                until, a = ra, inner_a
            else:
                until, b = rb + 1, inner_b
        self.valid[key] = found
        return found

    def last_token(self, word: str, end: int, lasts: list[str], tail: str = "") -> str:
        """The last token of word[:end], given those of its shorter prefixes (lasts[i] is that of the first i symbols)."""
        vocab, valid, sizes = self.vocab, self.valid, self.sizes[bool(tail)]
        some = None
        for known in (3, 2, 1):
            some = some or known <= end and sizes.get(word[end - known : end])
        for size in some or ():
            if size > end:
                continue
            token = word[end - size : end] + tail
            if token in vocab:
                met = valid.get((lasts[end - size], token))
                if met or met is None and self.follows(lasts[end - size], token):
                    return token
        raise ValueError(f"no token ends {word[max(0, end - 50) : end]!r}")

    def encode_words(self, words: Iterable[str]) -> None:
        """Keeps the ids of each word. Sorted words are the trie's depth-first order: the path to the node at hand is a stack; nodes near the root stay from batch to batch."""
        path, lasts, tail, width = "", [""], self.suffix, len(self.suffix)
        vocab, valid, follows, kept, sizes = self.vocab, self.valid, self.follows, self.nodes, self.sizes[0].get
        for word in sorted(words):
            same, inner = 0, len(word) - 1
            most = min(len(path), inner)
            while same < most and path[same] == word[same]:
                same += 1
            del lasts[same + 1 :]
            for i in range(same + 1, inner + 1):
                if i <= NODE_DEPTH and (last := kept.get(word[:i])) is not None:
                    lasts.append(last)
                    continue
                # as last_token() does; here for speed
                for size in i > 2 and sizes(word[i - 3 : i]) or i > 1 and sizes(word[i - 2 : i]) or sizes(word[i - 1 : i]):
                    if size <= i and (token := word[i - size : i]) in vocab:
                        before = lasts[i - size]
                        met = valid.get((before, token))
                        if met or met is None and follows(before, token):
                            break
                else:
                    raise ValueError(f"no token ends {word[max(0, i - 50) : i]!r}")
                lasts.append(token)
                if i <= NODE_DEPTH:
                    kept.new[word[:i]] = token
            path = word[:inner]
            token = self.last_token(word, len(word), lasts, tail)
            at, ids = len(word) - len(token) + width, [vocab[token]]
            while at:
                token = lasts[at]
                ids.append(vocab[token])
                at -= len(token)
            self.words.new[word] = struct.pack(f"<{len(ids)}I", *ids[::-1])

    # -- whole texts

    def learn(self, runs: list[bytes], special: bool) -> list[bytes]:
        """Encodings of runs; those not kept yet are worked out. special: whether there are special strings in any."""
        found = list(map(self.runs.get, runs))
        new = [i for i, ids in enumerate(found) if ids is None]
        # letters alone are one word; its characters stand for themselves
        cut = [run.decode().lower() if run.isalpha() else self.pieces(run) if special else self._words(run.decode("utf-8", "replace")) for run in map(runs.__getitem__, new)]
        known, wanted = self.words.get, set()
        for p in cut:
            if type(p) is str:
                wanted.add(p)
            else:
                wanted.update([w for w in p if type(w) is str])
        self.encode_words([w for w in wanted if known(w) is None])
        get = self.words.new.__getitem__
        for i, p in zip(new, cut, strict=True):
            if type(p) is str:
                ids = get(p)
            else:
                ids = b"".join([get(w) if type(w) is str else struct.pack("<I", w) for w in p])
            found[i] = self.runs.new[runs[i]] = ids
        return found

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts end to end, and where each text's begin (one more entry than texts).

        Each different run is looked up once, and its ids are then copied to every place where it stands.
        """
        for kept in (self.runs, self.words, self.nodes):
            kept.age()
        w = words_of(texts)
        which, at = w.numbered()
        raw = w.data.tobytes()
        special = any(a.encode() in raw for a in self.added)
        found = self.learn([raw[a:b] for a, b in zip(w.start[at].tolist(), w.end[at].tolist(), strict=True)], special)
        sizes = np.fromiter(map(len, found), np.int64, len(found)) // 4
        begin = np.cumsum(sizes) - sizes
        ids = gathered(np.frombuffer(b"".join(found), "<u4"), begin[which], sizes[which])
        return ids, np.concatenate([[0], np.cumsum(sizes[which])])[w.first]

    def decode_all(self, ids: np.ndarray) -> tuple[bytes, np.ndarray]:
        """The tokens of ids in UTF-8, a space before each, and where each ends."""
        if self.spelled is None:
            strings = [f" {self.tokens.get(i, '')}".encode() for i in range(max(self.tokens) + 1)]
            sizes = np.fromiter(map(len, strings), np.int64, len(strings))
            self.spelled = np.frombuffer(b"".join(strings), np.uint8), np.cumsum(sizes) - sizes, sizes
        data, begin, sizes = self.spelled
        return gathered(data, begin[ids], sizes[ids]).tobytes(), np.concatenate([[0], np.cumsum(sizes[ids])])

    def decode(self, ids: np.ndarray) -> str:
        """The tokens of ids joined by spaces, as the library gives them where the file names no decoder."""
        return " ".join(map(self.tokens.__getitem__, ids.tolist()))


_MODELS: dict[str, BpeModel] = {}


def model_at(path: str) -> BpeModel:
    if path not in _MODELS:
        _MODELS[path] = BpeModel(path)
    return _MODELS[path]


def digests(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, n_tokens and the digests of ids and of the decoded text, of every row; narrow."""
    ship(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = model_at(path)
        for batch in batches:
            for part in slices(batch, most=SLICE):
                ids, first = model.encode(part.column("text"))
                raw, (text, ends) = ids.tobytes(), model.decode_all(ids)
                a = [hashlib.sha256(raw[4 * i : 4 * j]).hexdigest() for i, j in zip(first.tolist(), first[1:].tolist(), strict=False)]
                b = [hashlib.sha256(text[i + 1 : j]).hexdigest() for i, j in zip(ends[first].tolist(), ends[first[1:]].tolist(), strict=False)]
                n = np.diff(first)
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(n, pa.int64()), pa.array(a), pa.array(b)], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def encoded(docs: DataFrame, path: str, decode: bool = False) -> DataFrame:
    """The rows without their text, with token_ids (and decoded, the text that the ids give back); narrow."""
    ship(docs.sparkSession)
    keep = [f for f in docs.schema.fields if f.name not in ("text", "token_ids", "n_tokens", "decoded")]
    schema = StructType(list(keep)).add("n_tokens", "long").add("token_ids", ArrayType(IntegerType()))
    if decode:
        schema = schema.add("decoded", "string")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = model_at(path)
        for batch in batches:
            for part in slices(batch, most=SLICE):
                ids, first = model.encode(part.column("text"))
                lists = pa.ListArray.from_arrays(pa.array(first.astype(np.int32)), pa.array(ids.astype(np.int32)))
                columns = [part.column(f.name) for f in keep] + [pa.array(np.diff(first), pa.int64()), lists]
                if decode:
                    columns.append(pa.array([model.decode(ids[i:j]) for i, j in zip(first.tolist(), first[1:].tolist(), strict=False)], pa.string()))
                yield pa.RecordBatch.from_arrays(columns, names=schema.names)

    return docs.mapInArrow(run, schema)
