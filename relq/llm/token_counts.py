"""Token counts that follow edits.

A document's tree has one leaf for some tens of segments: their length in code points and their tokens; sums stand
above. A segment begins at a space after a character that is no white space, and in long stretches without such spaces
where a letter is followed by what is neither letter nor white space: no token spans these places. An edit re-encodes
the leaves from the one with the character before it to the one with the character after it, so that both borders of
that region are borders still, and puts leaves of the usual size in their place; nothing else is encoded or summed
again. A run of letters without any border is one pre-token, which is encoded whole.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import small_batches, table
from .tokenizer import IRREGULAR, LONGEST, Encoder, default_path, encoder

#: Segments of a new leaf.
LEAF = 32
#: Borders within a segment; not before marks that names of added tokens hold, as an edit may complete such a name.
BORDER = regex.compile(r"(?<=\p{L})(?=[^\p{L}\s|<>])", regex.V1)


def leaves(encode: Encoder, text: str) -> tuple[list[int], list[int]]:
    """Code points and tokens of each leaf of a text, in order; the empty text has none."""
    if not text:
        return [], []
    first, *parts = text.split(" ")
    if IRREGULAR.search(text):  # a part that begins after white space belongs to the segment before it
        merged = [first]
        for p in parts:
            if merged[-1] and not merged[-1][-1].isspace():
                merged.append(p)
            else:
                merged[-1] += " " + p
        first, *parts = merged
    if max(map(len, parts), default=0) > LONGEST or len(first) > LONGEST:
        chars, tokens = [], []
        for k, p in enumerate([first, *parts]):
            whole = " " * (k > 0) + p
            if len(p) <= LONGEST:
                chars.append(len(whole))
                tokens.append(len(encode[p] if k else encode.raw(p)) // 4)
            else:
                own = [whole] if encode.has_special(p) else BORDER.split(whole)
                chars += map(len, own)
                tokens += [len(encode.raw(x)) // 4 for x in own]
    else:
        chars = np.append(len(first), np.fromiter(map(len, parts), np.int64, len(parts)) + 1)
        tokens = np.append(len(encode.raw(first)) // 4, np.fromiter(map(len, map(encode.__getitem__, parts)), np.int64, len(parts)) // 4)
    at = np.arange(0, len(chars), LEAF)
    return np.add.reduceat(chars, at).tolist(), np.add.reduceat(tokens, at).tolist()


class Node:
    """Sums of code points, tokens and leaves; kids is None for a leaf."""

    __slots__ = ("chars", "kids", "leaves", "tokens")

    def __init__(self, chars: int, tokens: int, kids: list[Node] | None = None) -> None:
        self.chars, self.tokens, self.leaves, self.kids = chars, tokens, 1, kids
        if kids is not None:
            self.add_up()

    def add_up(self) -> None:
        self.chars, self.tokens, self.leaves = (sum(getattr(x, n) for x in self.kids) for n in ("chars", "tokens", "leaves"))


class Tree:
    """Leaves under nodes of up to FANOUT children, which split where they grow beyond it and go where they are empty."""

    FANOUT = 32

    def __init__(self, chars: list[int], tokens: list[int]) -> None:
        level = [Node(c, t) for c, t in zip(chars, tokens)]
        while len(level) > self.FANOUT:
            level = [Node(0, 0, level[k : k + self.FANOUT]) for k in range(0, len(level), self.FANOUT)]
        self.root = Node(0, 0, level)

    @property
    def tokens(self) -> int:
        return self.root.tokens

    def find(self, at: int) -> tuple[int, int, int]:
        """The number of the leaf that holds the code point at a place (the last leaf beyond the end), where that leaf
        begins, and its length."""
        node, number, start = self.root, 0, 0
        while node.kids is not None:
            for x in node.kids[:-1]:
                if start + x.chars > at:
                    break
                number, start = number + x.leaves, start + x.chars
            else:
                x = node.kids[-1]
            node = x
        return number, start, node.chars

    def replace(self, a: int, b: int, chars: list[int], tokens: list[int]) -> None:
        """Puts the new leaves in place of a to b-1."""
        for _ in range(b - a):
            self._take(self.root, a)
        for i, (c, t) in enumerate(zip(chars, tokens)):
            more = self._put(self.root, a + i, Node(c, t))
            if more:
                self.root = Node(0, 0, [self.root, more])
        while self.root.kids and len(self.root.kids) == 1 and self.root.kids[0].kids is not None:
            self.root = self.root.kids[0]

    def _take(self, node: Node, k: int) -> None:
        for i, x in enumerate(node.kids):
            if k < x.leaves:
                break
            k -= x.leaves
        if x.kids is not None:
            self._take(x, k)
        if x.kids is None or not x.kids:
            del node.kids[i]
        node.add_up()

    def _put(self, node: Node, k: int, leaf: Node) -> Node | None:
        """Puts a leaf before the k-th; gives the node's new right neighbour where it had to be split."""
        if not node.kids or node.kids[0].kids is None:
            node.kids.insert(k, leaf)
        else:
            for i, x in enumerate(node.kids):
                if k <= x.leaves:
                    break
                k -= x.leaves
            more = self._put(x, k, leaf)
            if more:
                node.kids.insert(i + 1, more)
        right = None
        if len(node.kids) > self.FANOUT:
            right, node.kids = Node(0, 0, node.kids[self.FANOUT // 2 :]), node.kids[: self.FANOUT // 2]
        node.add_up()
        return right


def edit(encode: Encoder, tree: Tree, text: str, start: int, end: int, new: str) -> tuple[str, int]:
    """The text with new in place of [start, end), and how many code points were encoded for it; the tree follows."""
    start = min(max(start, 0), len(text))
    end = min(max(end, start), len(text))
    edited = text[:start] + new + text[end:]
    if not tree.root.leaves:
        tree.__init__(*leaves(encode, edited))
        return edited, len(edited)
    a, begin, _ = tree.find(max(start - 1, 0))
    b, last, size = tree.find(end)
    region = edited[begin : last + size + len(edited) - len(text)]
    chars, tokens = leaves(encode, region) if begin == 0 else _inner(encode, region)
    tree.replace(a, b + 1, chars, tokens)
    return edited, len(region)


def _inner(encode: Encoder, region: str) -> tuple[list[int], list[int]]:
    """Leaves of a region that begins at a border: encoded after a letter, which is then taken away."""
    chars, tokens = leaves(encode, "a" + region)
    chars, tokens = [chars[0] - 1, *chars[1:]], [tokens[0] - len(encode.raw("a")) // 4, *tokens[1:]]
    return (chars, tokens) if chars[0] else (chars[1:], tokens[1:])


def build(docs: DataFrame, path: str | None = None, keep: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, text, leaf_chars, leaf_tokens) and the columns of keep: each document's leaves.

    Null texts are empty ones and have no leaves; repeated rows and null ids stay; an empty table gives none.
    """
    small_batches(docs.sparkSession)
    path = path or default_path()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(path)
        for b in batches:
            made = [leaves(encode, t or "") for t in b.column("text").to_pylist()]
            more = [pa.array([m[k] for m in made], pa.list_(pa.int64())) for k in (0, 1)]
            yield pa.RecordBatch.from_arrays([*b.columns, *more], [*b.schema.names, "leaf_chars", "leaf_tokens"])

    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"), *keep)
    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in own.schema)
    return own.mapInArrow(run, f"{kinds}, leaf_chars array<long>, leaf_tokens array<long>")


def recount(trees: DataFrame, path: str | None = None) -> DataFrame:
    """Applies each row's edits, in order, to its tree.

    trees has build()'s columns and edits, array of (start, end, new) in code points of the text as it then is; places
    beyond the text mean its end, and null edits or parts of one nothing. Returns doc_id, n_tokens (before),
    edited_tokens, edited_chars, reencoded_chars, edited_text.
    """
    path = path or default_path()
    small_batches(trees.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(path)
        for b in batches:
            rows = []
            for doc_id, text, chars, tokens, edits in zip(*(c.to_pylist() for c in b.columns)):
                tree, total = Tree(chars, tokens), 0
                before = tree.tokens
                for e in edits or ():
                    if e and e["start"] is not None:
                        text, n = edit(encode, tree, text, e["start"], e["start"] if e["end"] is None else e["end"], e["new"] or "")
                        total += n
                rows.append((doc_id, before, tree.tokens, len(text), total, text))
            kinds = [pa.int64()] * 5 + [pa.string()]
            columns = zip(*rows) if rows else [()] * 6
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], ["doc_id", "n_tokens", "edited_tokens", "edited_chars", "reencoded_chars", "edited_text"])

    return trees.select("doc_id", "text", "leaf_chars", "leaf_tokens", "edits").mapInArrow(
        run, "doc_id long, n_tokens long, edited_tokens long, edited_chars long, reencoded_chars long, edited_text string"
    )


def op5_token_counts(spark, sf_dir: str) -> DataFrame:
    """Every document's tokens before and after three edits: words moved into its middle, a deletion, a new beginning."""
    docs = table(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    n, text = F.length("text"), F.col("text")
    one = lambda start, end, new: F.struct(start.cast("long").alias("start"), end.cast("long").alias("end"), new.alias("new"))
    half, quarter = F.floor(n / 2), F.floor(n / 4)
    edits = F.array(one(half, half + 16, F.substring(text, 1, 24)), one(quarter, quarter + 9, F.lit("")), one(F.lit(0), F.lit(0), F.substring(text, -8, 8)))
    done = recount(build(docs.withColumn("edits", edits), keep=("edits",)))
    return done.select("doc_id", "n_tokens", "edited_tokens", "edited_chars", "reencoded_chars", F.sha2("edited_text", 256).alias("edited_sha256"))
