"""BPE encoding and decoding of whole texts with a public vocabulary, by tree concatenation.

A text of more than ``leaf`` characters is a long unsplit text: it is halved, wherever that cuts it, down to leaves,
which are encoded on their own and side by side. Neighbours are then joined, level by level: a window of words around
the join, the one that the cut has split in its middle, is encoded again and grows until its outer words stand as they
stood in both neighbours. No token of the vocabulary reaches over ASCII white space, so all outside the window keeps
its tokens. A word's long pieces are halved and joined in the same way, by windows of tokens.

Each different word of a task is encoded once; the merges of all different pieces of a slice of texts are made side by
side in arrays. Texts of over ``PART`` characters are cut over tasks: their parts are rows, and the joins of all parts
of a text are made where these meet.
"""

from __future__ import annotations

import gc
import json
import re
from itertools import chain, islice

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stratamill.llm._shared import checkpointed, field, map_texts

LEAF = 4096
#: Bytes of texts that are encoded side by side: the more, the fewer words come again.
TOGETHER = 2_000_000
#: Characters of a part of a text that is cut over tasks.
PART = 1_000_000
#: Words that a task remembers, in each of two generations.
MEMO = 60_000


def byte_symbols() -> list[str]:
    """The printable character that byte-level vocabularies use for each byte."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    other = iter(range(256, 512))
    return [chr(b) if b in shown else chr(next(other)) for b in range(256)]


class Merges:
    """Byte-pair merges of many pieces at once: in each round, every piece makes its best merge, wherever it has it.

    A merge makes a symbol that only later merges take, as in every vocabulary that was learned merge by merge; so places
    of one merge are all made before any that it leads to, from left to right where they overlap, as in a run of equal
    symbols. Of other vocabularies each piece makes one merge in a round.
    """

    def __init__(self, model: dict):
        vocab = model["vocab"]
        self.end = model.get("end_of_word_suffix") or ""
        pairs = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        left = np.array([vocab[a] for a, _ in pairs], np.int64)
        right = np.array([vocab[b] for _, b in pairs], np.int64)
        self.size = max(vocab.values()) + 1
        keys = left * self.size + right
        order = np.argsort(keys)
        self.keys, self.rank = keys[order], order
        self.made = np.array([vocab[a + b] for a, b in pairs], np.int64)
        first_made = np.full(self.size, -1, np.int64)
        first_made[self.made[::-1]] = np.arange(len(pairs))[::-1]
        self.in_order = bool((np.maximum(first_made[left], first_made[right]) < np.arange(len(pairs))).all())
        #: Ids by the code points of symbols, inside a word and at its end.
        self.open_symbol, self.last_symbol = np.zeros(512, np.int64), np.zeros(512, np.int64)
        for s in byte_symbols():
            self.open_symbol[ord(s)], self.last_symbol[ord(s)] = vocab[s], vocab[s + self.end]

    def _ranks(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        k = a * self.size + b
        at = np.minimum(np.searchsorted(self.keys, k), len(self.keys) - 1)
        return np.where(self.keys[at] == k, self.rank[at], _NONE)

    def encode(self, pieces: list[str], last: bool = True) -> list[list[int]]:
        """Ids of each piece; ``last``: it ends its word."""
        if not pieces:
            return []
        codes = np.frombuffer("".join(pieces).encode("utf-32-le"), np.uint32)
        sizes = np.fromiter(map(len, pieces), np.int64, len(pieces))
        symbols, ends = self.open_symbol[codes], np.cumsum(sizes)
        if last:
            at = ends[sizes > 0] - 1
            symbols[at] = self.last_symbol[codes[at]]
        owner = np.repeat(np.arange(len(pieces)), sizes)
        done: list[tuple[np.ndarray, np.ndarray]] = []
        rank = np.full(len(symbols), _NONE)  # of each symbol with the next of its piece
        inner = np.flatnonzero(owner[1:] == owner[:-1])
        rank[inner] = self._ranks(symbols[inner], symbols[inner + 1])
        while len(symbols):
            heads = np.flatnonzero(np.concatenate([[True], owner[1:] != owner[:-1]]))
            best = np.minimum.reduceat(rank, heads)
            lengths = np.diff(np.concatenate([heads, [len(owner)]]))
            if (best == _NONE).any():
                going = np.repeat(best != _NONE, lengths)
                done.append((owner[~going], symbols[~going]))
                symbols, owner, rank = symbols[going], owner[going], rank[going]
                lengths, best = lengths[best != _NONE], best[best != _NONE]
                if not len(symbols):
                    break
                heads = np.cumsum(lengths) - lengths
            hits = np.flatnonzero(rank == np.repeat(best, lengths))
            if self.in_order:
                begins = np.concatenate([[True], hits[1:] != hits[:-1] + 1])  # of runs in which each overlaps the next
                place = np.arange(len(hits))
                at = hits[(place - place[begins][np.cumsum(begins) - 1]) % 2 == 0]
            else:
                at = hits[np.concatenate([[True], owner[hits][1:] != owner[hits][:-1]])]
            symbols[at] = self.made[rank[at]]
            stays = np.ones(len(symbols), bool)
            stays[at + 1] = False
            at = at - np.arange(len(at))  # where they stand once the merged symbols are out
            symbols, owner, rank = symbols[stays], owner[stays], rank[stays]
            for left in (at - 1, at):
                ok = (left >= 0) & (left + 1 < len(symbols))
                ok[ok] = owner[left[ok]] == owner[left[ok] + 1]
                rank[at[~ok & (left == at)]] = _NONE
                left = left[ok]
                rank[left] = self._ranks(symbols[left], symbols[left + 1])
        owners, ids = (np.concatenate(x) for x in zip(*done, strict=True)) if done else (np.zeros(0, np.int64),) * 2
        order = np.argsort(owners, kind="stable")
        flat, cuts = ids[order].tolist(), np.concatenate([[0], np.cumsum(np.bincount(owners, minlength=len(pieces)))]).tolist()
        return [flat[x:y] for x, y in zip(cuts[:-1], cuts[1:], strict=True)]


_NONE = np.int64(2**62)


class TreeEncoder:
    """Encodes texts exactly as the vocabulary file's own pipeline does."""

    def __init__(self, path: str, leaf: int = LEAF):
        import regex

        with open(path, encoding="utf-8") as f:
            file = json.load(f)
        self.path, self.leaf, self.library = path, max(2, leaf), None
        self.merges = Merges(file["model"])
        self.shown = {i: t.removesuffix(self.merges.end) for t, i in file["model"]["vocab"].items()}
        self.mapped = {b: s for b, s in enumerate(byte_symbols()) if chr(b) != s}
        #: For these the normalizer only lowers letters, and pieces follow the pattern below.
        self.plain = regex.compile(r"[\x21-\x7e\xa1-\xff]+").fullmatch
        self.pieces = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|\p{L}+|\p{N}|[^\s\p{L}\p{N}]+").findall
        self.ascii_pieces = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-z]+|[0-9]|[^a-z0-9]+").findall
        self.special = {x["content"]: x["id"] for x in file["added_tokens"]}
        self.cut = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special))) + ")").split
        self.memo: dict[bytes, tuple] = {}
        self.older: dict[bytes, tuple] = {}

    def _pieces(self, w: str) -> list[str]:
        """Pieces of a word in byte symbols; added tokens stand as they are."""
        if "<|" in w and any(x in w for x in self.special):
            return [y for x in self.cut(w) for y in ([x] if x in self.special else self._pieces(x) if x else [])]
        if w.isascii() and w.isprintable():
            w = w.lower()
            return [w] if w.isalpha() else self.ascii_pieces(w)
        if self.plain(w):
            return [x if x.isascii() else x.encode().decode("latin-1").translate(self.mapped) for x in self.pieces(w.lower())]
        if self.library is None:
            from tokenizers import Tokenizer

            self.library = Tokenizer.from_file(self.path)
        return [x for x, _ in self.library.pre_tokenizer.pre_tokenize_str(self.library.normalizer.normalize_str(w))]

    def _encoded(self, pieces: set[str]) -> dict[str, list[int]]:
        out = {x: [self.special[x]] for x in pieces & self.special.keys()}
        short = [x for x in pieces if len(x) <= self.leaf and x not in out]
        out |= zip(short, self.merges.encode(short), strict=True)
        return out | {x: self.tree(x) for x in pieces if len(x) > self.leaf and x not in self.special}

    def tree(self, p: str) -> list[int]:
        """Ids of a long piece: all leaves are encoded together, then neighbours are joined, level by level."""
        n = 1
        while len(p) > n * self.leaf:
            n *= 2
        cuts = [len(p) * i // n for i in range(n + 1)]
        leaves = [p[a:b] for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
        parts = [*self.merges.encode(leaves[:-1], False), *self.merges.encode(leaves[-1:])]
        while len(parts) > 1:
            parts = [self.joined(parts[i], parts[i + 1], i + 2 == len(parts)) for i in range(0, len(parts), 2)]
        return parts[0]

    def joined(self, left: list[int], right: list[int], last: bool) -> list[int]:
        """Ids of two neighbouring parts of one piece from the ids of each; ``last``: the right one ends its word."""
        n = 4
        while True:
            a, b = left[-n:], right[:n]
            again = self.merges.encode(["".join(map(self.shown.__getitem__, a + b))], last and n >= len(right))[0]
            held_left = n >= len(left) or len(again) > 1 and again[0] == a[0]
            held_right = n >= len(right) or len(again) > 1 and again[-1] == b[-1]
            if held_left and held_right:
                return left[:-n] + again + right[n:]
            n *= 2

    def _words(self, words: list[bytes]) -> list[tuple[int, ...]]:
        """Ids of different words."""
        known = [self.memo.get(w) or self.older.get(w) for w in words]
        new = {w: [w.lower().decode()] if w.isalpha() else self._pieces(w.decode()) for w, ids in zip(words, known, strict=True) if ids is None}
        if new:
            ids = self._encoded(set(chain.from_iterable(new.values())))
            made = {w: tuple(ids[p[0]]) if len(p) == 1 else tuple(chain.from_iterable(map(ids.__getitem__, p))) for w, p in new.items()}
            known = [made[w] if ids is None else ids for w, ids in zip(words, known, strict=True)]
        if len(self.memo) + len(words) > MEMO:
            self.memo, self.older = {}, self.memo
        # words seen again are kept, so common ones outlive a generation
        self.memo.update((w, x) for w, x in zip(words, known, strict=True) if len(w) <= 64)
        return known

    def leaves(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of texts encoded each on its own: all ids, where each word's ids begin, and where each text's words begin,
        one more at the end of both."""
        split = pc.ascii_split_whitespace(texts)
        flat = split.flatten()
        full = pc.greater(pc.binary_length(flat), 0).to_numpy(zero_copy_only=False)
        offsets = split.offsets.to_numpy() - split.offsets[0].as_py()
        first = np.concatenate([[0], np.cumsum(full)])[offsets]
        coded = flat.filter(pa.array(full)).dictionary_encode()
        word = coded.indices.to_numpy()
        each = self._words(coded.dictionary.cast(pa.binary()).to_pylist())
        sizes = np.fromiter(map(len, each), np.int64, len(each))
        table = np.fromiter(chain.from_iterable(each), np.int32, sizes.sum())
        many = sizes[word]
        begin = np.concatenate([[0], np.cumsum(many)])
        at = np.repeat((np.cumsum(sizes) - sizes)[word] - begin[:-1], many) + np.arange(begin[-1])
        return table[at], begin, first

    def texts(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """All ids of texts, and where those of each begin, one more at the end."""
        cut = [self.halves(t or "") for t in texts]
        parts = self.parts(list(chain.from_iterable(cut)))
        if len(parts) == len(texts):
            whole = parts
        else:
            ends = np.cumsum(list(map(len, cut))).tolist()
            whole = self.concatenated([parts[b - len(c) : b] for c, b in zip(cut, ends, strict=True)])
        ids = [x.ids for x in whole]
        return np.concatenate([np.zeros(0, np.int32), *ids]), np.concatenate([[0], np.cumsum(list(map(len, ids)), dtype=np.int64)])

    def halves(self, t: str) -> list[str]:
        """A text in a power of two of parts of ``leaf`` characters at most, or fewer where a word is longer than that;
        these are cut elsewhere."""
        n = 1
        while len(t) > n * self.leaf:
            n *= 2
        ends = [len(t) * k // n for k in range(1, n)]
        ends = [0, *(x for x in ends if SPACE.search(t, max(0, x - self.leaf), x + self.leaf)), len(t)]
        return [t[a:b] for a, b in zip(ends[:-1], ends[1:], strict=True)]

    def parts(self, texts: list[str]) -> list[Encoded]:
        """Texts, each encoded on its own."""
        gc.disable()  # hundreds of thousands of small lists and tuples, and no cycles
        try:
            ids, begin, first = self.leaves(pa.array(texts, pa.string()))
        finally:
            gc.enable()
        return [Encoded(t, ids[begin[a] : begin[b]], begin[a : b + 1] - begin[a]) for t, a, b in zip(texts, first[:-1].tolist(), first[1:].tolist(), strict=True)]

    def concatenated(self, texts: list[list[Encoded]]) -> list[Encoded]:
        """The parts of each text joined by twos, level by level; the joins of a level are made together."""
        while any(len(parts) > 1 for parts in texts):
            pairs = [(parts[k], parts[k + 1]) for parts in texts for k in range(0, len(parts) - 1, 2)]
            made = iter(self.together(pairs))
            texts = [[next(made) if k + 1 < len(parts) else parts[k] for k in range(0, len(parts), 2)] for parts in texts]
        return [parts[0] for parts in texts]

    def together(self, pairs: list[tuple[Encoded, Encoded]]) -> list[Encoded]:
        """Each two neighbouring parts of a text as one."""
        out: list = [None] * len(pairs)
        todo, n = list(range(len(pairs))), 2
        while todo:
            windows = [(*pairs[i][0].last_words(n), *pairs[i][1].first_words(n)) for i in todo]
            again = self.parts([pairs[i][0].text[a:] + pairs[i][1].text[:b] for i, (a, _, b, _) in zip(todo, windows, strict=True)])
            left_over = []
            for i, (_, in_left, _, in_right), new in zip(todo, windows, again, strict=True):
                left, right = pairs[i]
                many, k = len(new.begin) - 1, len(left.begin) - 1 - in_left
                held = in_left < n or many > 1 and np.array_equal(new.word(0), left.word(k))
                if held and (in_right < n or many > 1 and np.array_equal(new.word(many - 1), right.word(n - 1))):
                    x, y = left.begin[k], right.begin[in_right]
                    ids = np.concatenate([left.ids[:x], new.ids, right.ids[y:]])
                    begin = np.concatenate([left.begin[:k], new.begin[:-1] + x, right.begin[in_right:] + (x + len(new.ids) - y)])
                    out[i] = Encoded(left.text + right.text, ids, begin)
                else:
                    left_over.append(i)
            todo, n = left_over, 2 * n
        return out


#: ASCII white space, and words between it.
SPACE, WORD = re.compile(r"[\t-\r ]"), re.compile(r"[^\t-\r ]+")


class Encoded:
    """A part of a text, its ids, and where those of each word begin, one more at the end."""

    def __init__(self, text: str, ids: np.ndarray, begin: np.ndarray):
        self.text, self.ids, self.begin = text, ids, begin

    def word(self, i: int) -> np.ndarray:
        return self.ids[self.begin[i] : self.begin[i + 1]]

    def last_words(self, n: int) -> tuple[int, int]:
        """Where the last n words begin, or all if there are fewer, and how many these are."""
        size = 16 * n
        while True:
            at = max(0, len(self.text) - size)
            found = [m.start() for m in WORD.finditer(self.text, at)]
            if len(found) > n:  # the first of them may be the end of a word
                return found[-n], n
            if not at:
                return (found[0], n) if len(found) == n else (0, len(found))
            size *= 4

    def first_words(self, n: int) -> tuple[int, int]:
        """Where the first n words end, or all if there are fewer, and how many these are."""
        found = [m.end() for m in islice(WORD.finditer(self.text), n)]
        return (found[-1], n) if len(found) == n else (len(self.text), len(found))


def _lists(ids: np.ndarray, begin: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(begin.astype(np.int32)), pa.array(ids.astype(np.int32)))


def encode(df: DataFrame, path: str, text_col: str = "text", ids_col: str = "ids", leaf: int = LEAF, part: int = PART, decoded_col: str | None = None) -> DataFrame:
    """df with the ids of each whole text, array<int>; a null or empty text has none, in an empty array.

    With ``decoded_col`` there is also the text that the ids decode to, made in the same pass. Repeated rows each get
    theirs; columns of df named as these give way. ``path`` must exist on every executor, as an installed package's
    file does.
    """
    df = df.drop(*(c for c in (ids_col, decoded_col, "_row") if c and c != text_col))
    new = [field(ids_col, "array<int>"), *([field(decoded_col, "string")] if decoded_col else [])]

    def make():
        encoder, decoder = TreeEncoder(path, leaf), Decoder(path) if decoded_col else None

        def run(texts):
            lists = _lists(*encoder.texts(texts))
            return [lists, decoder.texts(lists)] if decoder else [lists]

        return run

    long = F.coalesce(F.length(F.col(f"`{text_col}`")) > part, F.lit(False))
    out = map_texts(df.where(~long), text_col, new, make, slice_bytes=TOGETHER)
    whole = df.where(long)
    if whole.isEmpty():
        return out

    def make_parts():
        encoder = TreeEncoder(path, leaf)

        def run(texts):
            found = encoder.concatenated([encoder.parts(encoder.halves(t)) for t in texts])
            flat = [np.concatenate([np.zeros(0, np.int64), *(getattr(x, k) for x in found)]) for k in ("ids", "begin")]
            return [_lists(x, np.concatenate([[0], np.cumsum([len(getattr(y, k)) for y in found])])) for x, k in zip(flat, ("ids", "begin"), strict=True)]

        return run

    def join(table):
        table = table.sort_by("part")
        encoder, decoder = TreeEncoder(path, leaf), Decoder(path) if decoded_col else None
        columns = [table.column(c).combine_chunks() for c in ("piece", "ids", "begin")]
        found = [Encoded(t.as_py(), i.values.to_numpy(), b.values.to_numpy()) for t, i, b in zip(*columns, strict=True)]
        ids = encoder.concatenated([found])[0].ids
        lists = _lists(ids, np.array([0, len(ids)]))
        return pa.table([table.column("_row").slice(0, 1), lists, *([decoder.texts(lists)] if decoder else [])], names=["_row", *(f.name for f in new)])

    whole = checkpointed(whole.withColumn("_row", F.monotonically_increasing_id()))
    text = F.col(f"`{text_col}`")
    cut = F.transform(F.sequence(F.lit(0), F.floor((F.length(text) - 1) / part).cast("int")), lambda i: text.substr(i * part + 1, F.lit(part)))
    parts = map_texts(whole.select("_row", F.posexplode(cut).alias("part", "piece")).repartition("_row", "part"), "piece", [field("ids", "array<int>"), field("begin", "array<int>")], make_parts)
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in new)
    joined = parts.groupBy("_row").applyInArrow(join, f"_row long, {kinds}")
    return out.unionByName(whole.drop(*(f.name for f in new)).join(joined, "_row").select(out.columns))


class Decoder:
    """The texts of ids, special tokens among them, as the vocabulary file's decoder gives them."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            file = json.load(f)
        if file["decoder"] is not None:
            raise ValueError("only vocabularies whose decoder joins tokens by a space are decoded")
        shown = {i: t for t, i in file["model"]["vocab"].items()} | {x["id"]: x["content"] for x in file["added_tokens"]}
        self.size = max(shown) + 1
        self.shown = pa.array([shown.get(i) for i in range(self.size + 1)], pa.string())

    def texts(self, lists: pa.Array) -> pa.Array:
        sizes = pc.fill_null(pc.list_value_length(lists), 0).to_numpy()
        ids = pc.fill_null(lists.flatten(), -1).to_numpy()
        shown = self.shown.take(pa.array(np.where((ids >= 0) & (ids < self.size), ids, self.size)))
        there = shown.is_valid().to_numpy(zero_copy_only=False)
        begin = np.concatenate([[0], np.cumsum(there)])[np.concatenate([[0], np.cumsum(sizes)])]
        return pc.binary_join(pa.ListArray.from_arrays(pa.array(begin.astype(np.int32)), shown.filter(pa.array(there))), " ")


def decode(df: DataFrame, path: str, ids_col: str = "ids", text_col: str = "decoded") -> DataFrame:
    """df with the text of each array of ids, as the vocabulary file's decoder gives it with special tokens kept.

    Null ids give an empty text; ids outside the vocabulary give nothing. A column named as ``text_col`` gives way.
    """

    def make():
        decoder = Decoder(path)
        return lambda lists: [decoder.texts(lists)]

    return map_texts(df, ids_col, [field(text_col, "string")], make, arrow=True)


def digests(df: DataFrame, ids_col: str = "ids", decoded_col: str = "decoded") -> DataFrame:
    """doc_id, n_tokens and the hashes of ids and decoded text."""
    return df.select(
        "doc_id",
        F.size(ids_col).cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col(ids_col).cast("array<string>"), " "), 256).alias("ids_sha256"),
        F.sha2(F.col(decoded_col), 256).alias("decoded_sha256"),
    )
