"""Personal data: fixed patterns, and a skip-chain conditional random field that adds to them.

Patterns give the base spans (email, ip, card, phone) in every text. The random field labels the tokens
with digits, @, = or +, those that a name of a secret introduces, and the other places of these, with such a
kind, with secret, or with nothing. Neighbouring tokens share a chain potential; a token that occurs again
anywhere in the document, or one of the same form, shares a skip potential with its occurrence before. A key
by itself could be anything (the number of a commit, say) and isn't labelled; one that is introduced once
(`token = "..."`) is found wherever it stands, as messages pass along the skip edges: without them only the
introduced place is (tested). Labels are the marginals of loopy message passing over each document's graph.

The weights are fitted by pseudo-likelihood on at most `SAMPLE` documents of at most `SAMPLE_BYTES` bytes,
whole ones, labelled by the patterns and by a few introductions of secrets. Introductions are held out in
the fit: each sampled token also stands without its context, once joined to its place by a skip edge with
the same label, and secrets once more alone, with none.

Spans that the field finds with a probability of `SURE`, that have the form of their kind and that touch no
base span are added.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from array import array
from bisect import bisect_left
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache
from itertools import accumulate

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import from_text, table

BASE_KINDS = ("email", "ip", "card", "phone")
KINDS = (*BASE_KINDS, "secret")
LABELS = ("", *KINDS)
SAMPLE = 2_000
SAMPLE_BYTES = 1 << 16
#: Nodes whose messages are passed together, and edges computed at a time.
NODES, BLOCK = 1 << 14, 1 << 16
SURE = 0.9
DIMENSIONS = 1 << 12
ROUNDS = 10

LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
DIGIT = re.compile(r"[0-9@=]")
NOT_DIGIT = re.compile(r"[^0-9]+")
INTRODUCED = re.compile(r"(?i)\b(?:token|password|passwd|secret|api[_-]?key)\s*[=:]\s*[\"']?([A-Za-z0-9_/+-]{12,})|\b(AKIA[0-9A-Z]{16})\b")

Span = tuple[str, int, int]


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if k % 2 == 0 else d * 2 - 9 * (d > 4)
    return total % 10 == 0


def emails(text: str) -> Iterator[tuple[int, int]]:
    """Leftmost matches: from each @ the local part is read backwards, so no run is scanned twice."""
    free = 0
    at = text.find("@")
    while at >= 0:
        start = at
        while start > free and text[start - 1] in LOCAL:
            start -= 1
        match = DOMAIN.match(text, at + 1) if start < at else None
        if match:
            yield start, match.end()
            free = match.end()
        else:
            free = max(free, at + 1)
        at = text.find("@", max(at + 1, free))


def base_spans(text: str) -> list[Span]:
    """Base spans by kind, then place."""
    found: list[Span] = []
    if "@" in text:
        found += [("email", a, b) for a, b in emails(text)]
    if DIGIT.search(text):
        for m in IP.finditer(text):
            if all(len(p := x.lstrip("0")) <= 3 and int(p or 0) <= 255 for x in m.group().split(".")):
                found.append(("ip", *m.span()))
        for m in CARD.finditer(text):
            if m.end() - m.start() >= 16 and 16 <= len(d := NOT_DIGIT.sub("", m.group())) <= 19 and luhn(d):
                found.append(("card", *m.span()))
        if "+" in text:
            for m in PHONE.finditer(text):
                if 8 <= len(NOT_DIGIT.sub("", m.group())) <= 15:
                    found.append(("phone", *m.span()))
    return found


# graph of a document
TOKEN = re.compile(r"\S+")
ROUGH = re.compile(r"[0-9@=+]")
DIGIT_OR_SIGN = re.compile(r"(?:[0-9@=+]\S*)")
EDGE = ".,;:!?\"'()[]{}<>|*&%$#"
CUES = frozenset("token password passwd secret key api apikey email mail e-mail tel phone call ip host server card visa iban = : + at to".split())
SAME, ALIKE = 0, 1


def shape(word: str) -> str:
    s = re.sub(r"[A-Z]+", "A", re.sub(r"[^\W\d_A-Z]+", "a", re.sub(r"[0-9]+", "9", word[:64])))
    return s[:14]


def cue(word: str) -> str:
    bare = word.strip(EDGE).lower() or word[:3].lower()
    return bare if bare in CUES else shape(bare) if ROUGH.search(bare) else "word"


LETTER_FORM = ["shape=letters", "long=letters", "digits=letters"]
LETTERS = [zlib.crc32(n.encode()) % DIMENSIONS for n in LETTER_FORM]


@lru_cache(1 << 14)
def node_features(word: str, before: str, after: str, marked: bool) -> tuple[int, ...]:
    """Feature numbers of a token between two cues; the whole token counts, its form is cut to 14 signs. marked: it may be labelled."""
    core = word.strip(EDGE)
    digits, plain = sum(c.isdigit() for c in core), not ROUGH.search(core)
    form = ["shape=" + shape(core), f"long={min(len(core), 48) // 4}", f"digits={min(digits, 24)}"]
    if marked and plain:  # letters that are marked have been introduced: no token like any other word
        form = LETTER_FORM
    names = ["bias", *form, "before=" + before, "after=" + after]
    if digits and re.fullmatch(r"[0-9a-f]{12,}", core):
        names.append("hex")
    if re.fullmatch(r"[0-9A-Z]{16,}", core) and digits and digits < len(core):
        names.append("capital")
    if digits == len(core) and 16 <= digits <= 19:
        names.append("luhn" if luhn(core) else "not luhn")
    if "=" in core[:-1]:
        names.append("name=" + core.split("=")[0].lower()[:10])
    if "@" in core:
        names.append("at")
    if plain and not marked:
        names.append("plain")
    return tuple(zlib.crc32(n.encode()) % DIMENSIONS for n in names)


@dataclass
class Graph:
    """Nodes of one text, flat: starts and ends of tokens, whether a token may be labelled, features (sizes says how
    many a node has), chain edges (pairs) and skip edges (triples with SAME or ALIKE)."""

    starts: array = field(default_factory=lambda: array("q"))
    ends: array = field(default_factory=lambda: array("q"))
    marked: bytearray = field(default_factory=bytearray)
    features: array = field(default_factory=lambda: array("H"))
    sizes: array = field(default_factory=lambda: array("B"))
    chain: array = field(default_factory=lambda: array("q"))
    skip: array = field(default_factory=lambda: array("q"))

    def __len__(self) -> int:
        return len(self.starts)


def core_of(word: str) -> str:
    """What repeats are told by: the token without signs around it and without a name before =."""
    return word.strip(EDGE).split("=")[-1].strip(EDGE).lower()


def graph_of(text: str) -> Graph:
    starts, ends = array("q"), array("q")
    for m in TOKEN.finditer(text):
        starts.append(m.start())
        ends.append(m.end())
    n = len(starts)
    word = lambda i: text[starts[i] : ends[i]] if 0 <= i < n else ""
    marked = bytearray(n)
    for m in DIGIT_OR_SIGN.finditer(text):
        marked[bisect_left(ends, m.start() + 1)] = 1
    named, introduced = set(), set()
    for m in INTRODUCED.finditer(text):
        at = m.start(1 if m.group(1) else 2)
        i = bisect_left(ends, at + 1)
        introduced.add(i)
        if not marked[i]:
            marked[i] = 1
            named.add(core_of(word(i)))
    if named:  # other places of what was introduced and has no digit or sign
        for i in range(n):
            if not marked[i] and core_of(word(i)) in named:
                marked[i] = 1
    g, last, before = Graph(), {}, -2
    for i in range(n):
        if not (marked[i] or i and marked[i - 1] or i + 1 < n and marked[i + 1]):
            continue
        k = len(g.starts)
        g.starts.append(starts[i])
        g.ends.append(ends[i])
        g.marked.append(marked[i])
        found = node_features(word(i), "introduced" if i in introduced else cue(word(i - 1)), cue(word(i + 1)), bool(marked[i]))
        g.features.extend(found)
        g.sizes.append(len(found))
        if before == i - 1:
            g.chain.extend((k - 1, k))
        before = i
        if marked[i] and (core := core_of(word(i))):
            alike = (shape(core), len(core), core[:4])
            if core in last:
                g.skip.extend((last[core], k, SAME))
            elif alike in last:
                g.skip.extend((last[alike], k, ALIKE))
            last[core] = last[alike] = k
    return g


def taught(text: str, graph: Graph) -> list[int]:
    """Labels of the nodes from the base spans and from introduced secrets; of several the first kind counts."""
    spans = base_spans(text) + [("secret", *m.span(1 if m.group(1) else 2)) for m in INTRODUCED.finditer(text)]
    labels = [0] * len(graph)
    for kind in reversed(KINDS):
        mine = sorted((s, e) for k, s, e in spans if k == kind)
        firsts = [s for s, _ in mine]
        for i, (a, b) in enumerate(zip(graph.starts, graph.ends, strict=True)):
            at = bisect_left(firsts, b)
            if at and mine[at - 1][1] > a:
                labels[i] = LABELS.index(kind)
    return labels


@dataclass
class Field:
    """Weights: features x labels, chain (left, right), and skip (kind, label, label), symmetric."""

    unary: np.ndarray
    chain: np.ndarray
    skip: np.ndarray


def fit(graphs: list[tuple], rounds: int = 250, penalty: float = 1e-6) -> Field:
    """Pseudo-likelihood: each label given its features and its neighbours' labels.

    graphs: features, sizes, chain, skip (all flat), marked, and labels. Every token that may be labelled also
    stands without its context, joined to itself by a skip edge, of either kind in turn, over which it learns
    the label (but doesn't tell its own); secrets stand a third time, alone and without a label, so that it
    takes the skip edge to know them, and once in their context as letters only.
    """
    size, node, feature, y, left, skips, held_out = len(LABELS), [], [], [], [], [], []
    bare = zlib.crc32(b"before=word") % DIMENSIONS, zlib.crc32(b"after=word") % DIMENSIONS
    at, secret = 0, LABELS.index("secret")
    for features, sizes, chain, skip, marked, labels in graphs:
        begin = [0, *accumulate(sizes)]
        extra = at + len(sizes)
        node += [at + k for k, n in enumerate(sizes) for _ in range(n)]
        feature += list(features)
        y += list(labels)
        left += [(at + a, at + b) for a, b in zip(chain[::2], chain[1::2], strict=True)]
        skips += [(at + a, at + b, t) for a, b, t in zip(skip[::3], skip[1::3], skip[2::3], strict=True)]
        for k, label in enumerate(labels):
            if not marked[k]:
                continue
            whole = list(features[begin[k] : begin[k + 1]])
            if label == secret:
                letters = [whole[0], *LETTERS, *whole[4:6]]
                node += [extra] * len(letters)
                feature += letters
                y.append(label)
                extra += 1
            f = [*whole[:4], *bare, *whole[6:]]
            for joined in (True, False)[: 1 + (label == secret)]:
                node += [extra] * len(f)
                feature += f
                y.append(label if joined else 0)
                if joined:
                    held_out.append((at + k, extra, extra % 2))
                extra += 1
        at = extra
    field = Field(np.zeros((DIMENSIONS, size)), np.zeros((size, size)), np.zeros((2, size, size)))
    if not y:
        return field
    node, feature, y = np.array(node), np.array(feature), np.array(y)
    left = np.array(left, int).reshape(-1, 2)
    # an edge works both ways: two directed ones; held-out places only listen
    skips = np.array([*skips, *((b, a, t) for a, b, t in skips), *held_out], int).reshape(-1, 3)
    one = np.eye(size)[y]
    weights = [field.unary, field.chain, field.skip]
    first, second = [np.zeros_like(w) for w in weights], [np.zeros_like(w) for w in weights]
    a, b = left[:, 0], left[:, 1]
    i, j, t = skips[:, 0], skips[:, 1], skips[:, 2]
    for step in range(1, rounds + 1):
        z = np.stack([np.bincount(node, field.unary[feature, k], len(y)) for k in range(size)], axis=1)
        np.add.at(z, b, field.chain[y[a]])
        np.add.at(z, a, field.chain[:, y[b]].T)
        np.add.at(z, j, field.skip[t, y[i]])
        z -= z.max(1, keepdims=True)
        p = np.exp(z)
        p /= p.sum(1, keepdims=True)
        off = (p - one) / len(y)
        gradients = [np.zeros_like(w) for w in weights]
        for k in range(size):
            gradients[0][:, k] = np.bincount(feature, off[node, k], DIMENSIONS)
        np.add.at(gradients[1], y[a], off[b])
        np.add.at(gradients[1].T, y[b], off[a])
        np.add.at(gradients[2], (t, y[i]), off[j])
        gradients[2] = (gradients[2] + gradients[2].transpose(0, 2, 1)) / 2
        for w, g, m, v in zip(weights, gradients, first, second, strict=True):
            g = g + penalty * w
            m += 0.1 * (g - m)
            v += 0.01 * (g * g - v)
            w -= 0.15 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-6)
    return field


def marginals(graphs: list[Graph], field: Field, rounds: int = ROUNDS) -> list[np.ndarray]:
    """Loopy belief propagation over all graphs at once; they share no edge, so none depends on another. Exact on trees."""
    begin = np.r_[0, np.cumsum([len(g) for g in graphs])].astype(np.int64)
    n, size = int(begin[-1]), len(LABELS)
    if not n:
        return [np.zeros((0, size), np.float32) for _ in graphs]
    flat = lambda name, kind: np.concatenate([np.frombuffer(getattr(g, name), kind) for g in graphs])
    sizes, features = flat("sizes", np.uint8).astype(np.int64), flat("features", np.uint16)
    edges = np.r_[0, np.cumsum(sizes)]
    unary = np.zeros((n, size), np.float32)
    for k in range(0, n, BLOCK):
        low, high = edges[k], edges[min(n, k + BLOCK)]
        unary[k : k + BLOCK] = np.add.reduceat(field.unary[features[low:high]], edges[k : min(n, k + BLOCK)] - low)
    pairs = [np.frombuffer(g.chain, np.int64).reshape(-1, 2) + o for g, o in zip(graphs, begin, strict=False)]
    joined = [np.frombuffer(g.skip, np.int64).reshape(-1, 3) + np.array([o, o, 1]) for g, o in zip(graphs, begin, strict=False)]
    e = np.concatenate([*(np.c_[p, np.zeros(len(p), np.int64)] for p in pairs), *joined]).astype(np.int32)
    tables = np.stack([field.chain, field.skip[0], field.skip[1]]).astype(np.float32)
    forth = np.zeros((len(e), size), np.float32)
    back = np.zeros((len(e), size), np.float32)

    def pushed(belief: np.ndarray, potential: np.ndarray) -> np.ndarray:
        z = belief[:, :, None] + potential
        top = z.max(1, keepdims=True)
        out = np.log(np.exp(z - top).sum(1)) + top[:, 0]
        return out - out.max(1, keepdims=True)

    belief = unary.copy()
    for _ in range(rounds if len(e) else 0):
        for k in range(0, len(e), BLOCK):
            x, there, here = e[k : k + BLOCK], forth[k : k + BLOCK].copy(), back[k : k + BLOCK]
            forth[k : k + BLOCK] = 0.5 * (there + pushed(belief[x[:, 0]] - here, tables[x[:, 2]]))
            back[k : k + BLOCK] = 0.5 * (here + pushed(belief[x[:, 1]] - there, tables[x[:, 2]].transpose(0, 2, 1)))
        belief[:] = unary
        for k in range(0, len(e), BLOCK):
            np.add.at(belief, e[k : k + BLOCK, 1], forth[k : k + BLOCK])
            np.add.at(belief, e[k : k + BLOCK, 0], back[k : k + BLOCK])
    p = np.exp(belief - belief.max(1, keepdims=True))
    p /= p.sum(1, keepdims=True)
    return [p[a:b] for a, b in zip(begin[:-1].tolist(), begin[1:].tolist(), strict=True)]


def plausible(kind: str, core: str) -> bool:
    """Whether a token can be of its kind at all."""
    digits = sum(c.isdigit() for c in core)
    if kind == "email":
        return 0 < core.find("@") < len(core) - 1
    if kind == "ip":
        return bool(re.fullmatch(r"[0-9]{1,3}(?:\.[0-9]{1,3}){3}|[0-9A-Fa-f]{0,4}(?::[0-9A-Fa-f]{0,4}){2,7}", core))
    if kind == "card":
        return 12 <= digits <= 19 and digits >= len(core) - 4
    return kind != "secret" or len(core) >= 8


def added_spans(text: str, graph: Graph, p: np.ndarray, base: list[Span], sure: float = SURE) -> list[Span]:
    """Spans of sure labels that touch no base span; neighbouring phone tokens are one span, of 7 to 15 digits."""
    taken = sorted((s, e) for _, s, e in base)
    firsts, upto = [s for s, _ in taken], list(accumulate((e for _, e in taken), max))
    found: list[Span] = []
    best = p.argmax(1)
    for k in np.flatnonzero((best > 0) & (p.max(1, initial=0) >= sure)).tolist():
        if not graph.marked[k]:
            continue
        kind, a = LABELS[best[k]], graph.starts[k]
        word = text[a : graph.ends[k]]
        core = word.strip(EDGE)
        if kind == "secret":
            core = core.split("=")[-1].strip(EDGE)
        if not core or not plausible(kind, core):
            continue
        start = a + word.rindex(core)
        end = start + len(core)
        at = bisect_left(firsts, end)
        if at and upto[at - 1] > start:
            continue
        if found and found[-1][0] == kind == "phone" and text[found[-1][2] : start].strip(EDGE + " ") == "":
            found[-1] = ("phone", found[-1][1], end)
        else:
            found.append((kind, start, end))
    return [x for x in found if x[0] != "phone" or 7 <= sum(c.isdigit() for c in text[x[1] : x[2]]) <= 15]


def fit_on(docs: DataFrame, text: str = "text", sample: int = SAMPLE) -> Field:
    """The field for `docs`, from the sampled texts with the least hashes among those with digits or @; equal texts count once.

    Only texts with hashes below a bound, of which there are about a quarter more than wanted, are brought
    together, so that what the last task reads doesn't grow with the number of partitions.
    """
    marked = docs.select(F.col(f"`{text}`").alias("t")).where(F.col("t").rlike("[0-9@]") & (F.octet_length("t") <= SAMPLE_BYTES)).withColumn("h", F.xxhash64("t"))
    distinct = marked.agg(F.approx_count_distinct("h", 0.02)).head()[0]
    bound = min(1.0, (1.25 * sample + 100) / max(1, distinct))
    near = marked.where(F.col("h").cast("double") / 2.0**64 + 0.5 <= bound)
    chosen = near.groupBy("h").agg(F.min("t").alias("t")).orderBy("h").limit(sample)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for t in b["t"]:
                g = graph_of(t)
                rows.append((g.features.tolist(), g.sizes.tolist(), g.chain.tolist(), g.skip.tolist(), list(g.marked), taught(t, g)))
            yield pd.DataFrame(rows, columns=list("fncsmy"))

    found = chosen.mapInPandas(run, ", ".join(f"{c} array<int>" for c in "fncsmy"))
    return fit([tuple(r) for r in found.toLocalIterator()])


def find(df: DataFrame, field: Field, text: str = "text", keep_text: bool = True) -> DataFrame:
    """`df` with _base and _added: arrays of kind, start and end (code points, end exclusive).

    Null and empty texts have no spans; repeated rows are read each.
    """
    shared = df.sparkSession.sparkContext.broadcast(field)

    def read(given: list[str | None]) -> Iterator[tuple[list[dict], list[dict]]]:
        as_rows = lambda spans: [{"kind": k, "start": s, "end": e} for k, s, e in spans]
        texts = [t or "" for t in given]
        rough = [i for i, t in enumerate(texts) if DIGIT.search(t) or INTRODUCED.search(t)]
        base = {i: base_spans(texts[i]) for i in rough}
        more: dict[int, list[Span]] = {}
        held: list[tuple[int, Graph]] = []

        def settle() -> None:
            for (i, g), p in zip(held, marginals([g for _, g in held], shared.value), strict=True):
                more[i] = added_spans(texts[i], g, p, base[i])
            held.clear()

        for i in rough:
            held.append((i, graph_of(texts[i])))
            if sum(len(g) for _, g in held) >= NODES or len(held) >= 256:
                settle()
        settle()
        for i in range(len(texts)):
            yield as_rows(base.get(i, [])), as_rows(more.get(i, []))

    kind = "array<struct<kind:string,start:long,end:long>>"
    return from_text(df, text, f"_base {kind}, _added {kind}", read, as_bytes=False, keep_text=keep_text)


def masked(text: str, spans: list[Span]) -> str:
    """`text` with each span replaced by its kind in angle brackets; of overlapping spans the first counts."""
    out, at = [], 0
    for kind, start, end in sorted(spans, key=lambda s: (s[1], -s[2])):
        if start >= at:
            out += [text[at:start], f"<{kind}>"]
            at = end
    return "".join([*out, text[at:]])


def personal_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op4: every document with its counts of base spans, their digest, and all spans.

    n_secret, n_spans and personal (whether there is any span) count what the field adds too. Null and empty
    texts have no spans; repeated rows get equal results.
    """
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = find(docs, fit_on(docs), keep_text=False)
    rank = F.expr("map(" + ", ".join(f"'{k}', {i}" for i, k in enumerate(KINDS)) + ")")
    both = F.array_sort(F.transform(F.concat("_base", "_added"), lambda s: F.struct(F.element_at(rank, s["kind"]).alias("r"), s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind"))))
    written = lambda c: F.array_join(F.transform(c, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    counts = [_count(k) for k in BASE_KINDS]
    n = (F.size("_base") + F.size("_added")).cast("long")
    secrets = F.size(F.filter("_added", lambda s: s["kind"] == "secret")).cast("long")
    return found.select("doc_id", *counts, F.sha2(written(F.col("_base")), 256).alias("base_sha256"), written(both).alias("spans"), secrets.alias("n_secret"), n.alias("n_spans"), (n > 0).alias("personal"))


def _count(kind: str):
    return F.size(F.filter("_base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")


def digest(spans: list[Span]) -> str:
    return hashlib.sha256(",".join(f"{k}:{s}:{e}" for k, s, e in spans).encode()).hexdigest()
