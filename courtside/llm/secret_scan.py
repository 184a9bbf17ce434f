"""Secret scans: three fixed patterns, and a character network for what they miss.

Every token of a text of 12 characters or more with a digit that lies outside the
fixed patterns is a candidate: keys of other formats, but also mail addresses, numbers and ids. A convolutional network over characters, written in
numpy, reads each candidate with the characters around it; a candidate whose calibrated
probability passes the threshold becomes a span of kind ``model``. The threshold
is the highest that still finds ``recall`` of the held-out labelled secrets. Fitting, calibration and threshold use separate parts of the labels.

Texts are read once: a task writes the spans of the patterns and the candidates' windows
(a small part of the text) to the shared folder, the network is trained on a bounded number of
labelled findings and then scores every candidate in parallel. Labelled are, in the corpus, the spans of the patterns (secrets) and the candidates
that are plainly something else (addresses, plain numbers, runs too short for the patterns), beside generated findings of public formats.
"""

from __future__ import annotations

import base64
import hashlib
import re
import string
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from courtside.llm.common import map_batches, texts_of
from courtside.session import stage

KINDS = ("assign", "access", "hex", "model")
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{32,}")
CANDIDATE = re.compile(r"[A-Za-z0-9+/_=.@-]{12,}")
#: Candidates of these shapes are labelled harmless: mail addresses, numbers and dates, runs too short for the patterns.
HARMLESS = re.compile(r"[^@]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}\.?|[0-9.+/=_-]+|AKIA[A-Z0-9]{8,11}|[0-9a-f]{12,31}")
#: A window has so many characters before the candidate, of it and after it; a longer candidate has several windows.
BEFORE, WITHIN, AFTER = 24, 40, 8
WINDOW = BEFORE + WITHIN + AFTER

Span = tuple[int, int, str]


def base_spans(text: str) -> list[Span]:
    """(start, end, kind) of the fixed patterns, leftmost and non-overlapping within a kind, by start and kind."""
    found = [(m.start(), m.end(), "assign") for m in ASSIGN.finditer(text) if len(m[2]) >= 8]
    if "AKIA" in text:
        found += [(m.start(), m.end(), "access") for m in ACCESS.finditer(text) if m.end() - m.start() >= 16]
    found += [(m.start(), m.end(), "hex") for m in HEX.finditer(text)]
    return sorted(found, key=lambda s: (s[0], KINDS.index(s[2])))


def candidates(text: str, base: list[Span]) -> list[tuple[int, int]]:
    """Spans of 12 or more token characters with a digit that touch no span of ``base``."""
    out, at, reach = [], 0, 0
    for m in CANDIDATE.finditer(text):
        a, b = m.span()
        while at < len(base) and base[at][0] < b:
            reach = max(reach, base[at][1])
            at += 1
        if reach <= a and re.search(r"[0-9]", m[0]):
            out.append((a, b))
    return out


def windows(text: str, start: int, end: int) -> list[str]:
    """The span's windows, padded to their width; they overlap by half if there are several."""
    before = text[max(0, start - BEFORE):start].rjust(BEFORE)
    after = text[end:end + AFTER].ljust(AFTER)
    starts = range(start, max(start + 1, end - WITHIN // 2), WITHIN // 2) if end - start > WITHIN else [start]
    return [before + text[a:min(a + WITHIN, end)].ljust(WITHIN) + after for a in starts]


_CODES = np.full(128, 1, np.uint8)
for _i, _c in enumerate(string.ascii_letters + string.digits + " +/_=-.:\"'|,"):
    _CODES[ord(_c)] = 2 + _i
N_CODES = int(_CODES.max()) + 1


def encode(texts: list[str]) -> np.ndarray:
    """One small code per character; characters beyond ASCII share code 1."""
    codes = np.frombuffer("".join(texts).encode("utf-32-le"), np.uint32).reshape(len(texts), WINDOW)
    return _CODES[np.minimum(codes, 127)]


@dataclass
class Network:
    """Embedding, two convolution widths with maximum pooling, one logistic unit; then calibration."""

    w: dict[str, np.ndarray]
    scale: float = 1.0
    shift: float = 0.0
    threshold: float = 0.5
    #: Share of secrets among the held-out findings at or above the threshold.
    precision: float = 0.0

    WIDTHS = (3, 7)

    @classmethod
    def fresh(cls, seed: int, depth: int = 8, filters: int = 16) -> Network:
        rng = np.random.default_rng(seed)
        w = {"embed": rng.normal(0, 0.3, (N_CODES, depth)), "out": rng.normal(0, 0.1, filters * len(cls.WIDTHS) * 2), "bias": np.zeros(1)}
        for k in cls.WIDTHS:
            w[f"conv{k}"] = rng.normal(0, (2 / (k * depth)) ** 0.5, (k * depth, filters))
            w[f"add{k}"] = np.zeros(filters)
        return cls(w)

    def forward(self, codes: np.ndarray) -> tuple[np.ndarray, list]:
        """Logits, and what the backward pass needs. Pools the candidate and its context apart."""
        x, kept, pooled = self.w["embed"][codes], [], []
        for k in self.WIDTHS:
            view = np.lib.stride_tricks.sliding_window_view(x, k, axis=1).transpose(0, 1, 3, 2)
            flat = view.reshape(len(x), WINDOW - k + 1, -1)
            z = np.maximum(flat @ self.w[f"conv{k}"] + self.w[f"add{k}"], 0)
            inner = np.zeros(z.shape[1], bool)
            inner[BEFORE:BEFORE + WITHIN - k + 1] = True
            for mask in (inner, ~inner):
                places = np.flatnonzero(mask)
                top = places[z[:, mask].argmax(axis=1)]
                best = np.take_along_axis(z, top[:, None, :], 1)[:, 0]
                pooled.append(best)
                kept.append((k, flat, top, best))
        hidden = np.hstack(pooled)
        return hidden @ self.w["out"] + self.w["bias"][0], [hidden, kept]

    def gradient(self, codes: np.ndarray, y: np.ndarray) -> dict[str, np.ndarray]:
        logit, (hidden, kept) = self.forward(codes)
        error = (1 / (1 + np.exp(-logit)) - y) / len(y)
        g = {k: np.zeros_like(v) for k, v in self.w.items()}
        g["out"], g["bias"] = hidden.T @ error, np.array([error.sum()])
        back, at, rows, depth = np.outer(error, self.w["out"]), 0, np.arange(len(y))[:, None], self.w["embed"].shape[1]
        for k, flat, top, best in kept:
            f = best.shape[1]
            d = back[:, at:at + f] * (best > 0)
            at += f
            seen = flat[rows, top]
            g[f"conv{k}"] += np.einsum("bfx,bf->xf", seen, d)
            g[f"add{k}"] += d.sum(axis=0)
            to_x = (d[:, :, None] * self.w[f"conv{k}"].T[None]).reshape(len(y), f, k, depth)
            np.add.at(g["embed"], codes[rows[:, :, None], top[:, :, None] + np.arange(k)], to_x)
        return g

    def probability(self, texts: list[str]) -> np.ndarray:
        parts = [self.forward(encode(texts[i:i + 512]))[0] for i in range(0, len(texts), 512)]
        return 1 / (1 + np.exp(-(np.concatenate(parts) * self.scale + self.shift))) if parts else np.empty(0)


def generated_findings(n: int, seed: int) -> list[tuple[str, int]]:
    """Labelled windows of public key formats (1) and of harmless long tokens (0)."""
    rng = np.random.default_rng(seed)
    pick = lambda alphabet, size: "".join(rng.choice(list(alphabet), size))
    mixed = string.ascii_letters + string.digits
    syllables = ["the", "an", "er", "tion", "re", "ing", "st", "ha", "und", "qu", "el", "os", "ment", "eau", "ge", "ver"]
    word = lambda: "".join(rng.choice(syllables, rng.integers(1, 4)))
    secrets = [
        lambda: "ghp_" + pick(mixed, 36), lambda: "sk_live_" + pick(mixed, 24), lambda: "xoxb-" + pick(string.digits, 12) + "-" + pick(mixed, 24),
        lambda: "AIza" + pick(mixed + "_-", 35), lambda: "eyJ" + pick(mixed, 30), lambda: pick(mixed + "+/", 40), lambda: pick(mixed, 32),
        lambda: pick("0123456789ABCDEF", 32), lambda: base64.b64encode(rng.bytes(24)).decode(), lambda: "glpat-" + pick(mixed, 20),
    ]
    harmless = [
        lambda: "-".join(word() for _ in range(5)) + str(rng.integers(1, 99)), lambda: "_".join(word() for _ in range(4)) + "_" + str(rng.integers(1, 9999)),
        lambda: "/" + "/".join(word() for _ in range(4)) + "/" + str(rng.integers(1, 9999)), lambda: "2" + pick(string.digits, 3) + "-0" + pick("123456789", 1) + "-" + "1T10" + "0" * 8,
        lambda: word() + word() + word() + word() + word() + str(rng.integers(1, 99)), lambda: "=" * int(rng.integers(14, 30)) + word() + "1",
        lambda: word() + str(rng.integers(1900, 2030)) + "/" + word() + word() + word() + word(), lambda: "A" * 15 + str(rng.integers(1, 99)),
    ]
    labels = rng.integers(0, 2, n)
    out = []
    for y in labels:
        made = (secrets if y else harmless)[rng.integers(0, len(secrets if y else harmless))]()
        text = " ".join(word() for _ in range(5)) + rng.choice([" ", ' "', "=", " = ", ": "]) + made + rng.choice([" ", '"', ".", ","]) + word() + " " + word()
        at = text.index(made)
        out.append((windows(text, at, at + len(made))[0], int(y)))
    return out


def train(findings: list[tuple[str, int]], recall: float = 0.95, epochs: int = 6, seed: int = 7) -> Network:
    """Fit on three fifths of ``findings`` (window, 0/1), calibrate on a fifth, choose the threshold on the last one.

    Without both labels in each part the network stays silent (threshold above 1).
    """
    net, rng = Network.fresh(seed), np.random.default_rng(seed)
    order = rng.permutation(len(findings))
    codes = encode([findings[i][0] for i in order]) if len(order) else np.empty((0, WINDOW), np.uint8)
    y = np.array([findings[i][1] for i in order], float)
    cut, last = len(y) * 3 // 5, len(y) * 4 // 5
    if any(len(set(part)) < 2 for part in (y[:cut], y[cut:last], y[last:])):
        net.threshold = 2.0
        return net
    m, v, step = {k: np.zeros_like(x) for k, x in net.w.items()}, {k: np.zeros_like(x) for k, x in net.w.items()}, 0
    for _ in range(epochs):
        for part in np.array_split(rng.permutation(cut), max(1, cut // 64)):
            step += 1
            for k, g in net.gradient(codes[part], y[part]).items():
                m[k] = 0.9 * m[k] + 0.1 * g
                v[k] = 0.999 * v[k] + 0.001 * g * g
                net.w[k] -= 0.01 * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.999**step)) + 1e-8)
    logit, held = net.forward(codes[cut:last])[0], y[cut:last]
    for _ in range(200):  # calibration: a logistic curve over the held-out logits
        p = 1 / (1 + np.exp(-(net.scale * logit + net.shift)))
        net.scale -= 0.1 * ((p - held) * logit).mean()
        net.shift -= 0.1 * (p - held).mean()
    logit, held = net.forward(codes[last:])[0], y[last:]
    every = 1 / (1 + np.exp(-(net.scale * logit + net.shift)))
    p = np.sort(every[held == 1])
    net.threshold = float(p[int((1 - recall) * len(p))])
    net.precision = float(held[every >= net.threshold].mean())
    return net


def findings_of(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", *more: str) -> DataFrame:
    """Per row: the id, ``more``, ``base`` (starts, ends, kinds as arrays) and the candidates with their windows."""
    picked = docs.select(id_column, F.col(text_column).alias("text"), *more)
    kept, types = [c for c in picked.columns if c != "text"], dict(picked.dtypes)

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        rows = []
        for text in texts_of(batch):
            base = base_spans(text)
            rest = [(a, b, windows(text, a, b)) for a, b in candidates(text, base)]
            rows.append((
                [{"s": a, "e": b, "k": k} for a, b, k in base],
                [{"s": a, "e": b, "k": w} for a, b, w in rest],
                [{"w": w, "y": 1} for a, b, k in base if k != "assign" for w in windows(text, a, b)]
                + [{"w": w, "y": 0} for a, b, of in rest if HARMLESS.fullmatch(text, a, b) for w in of]))
        span = pa.struct([("s", pa.int64()), ("e", pa.int64())])
        fields = lambda kind: pa.list_(pa.struct([*span, ("k", kind)]))
        base, more_, labelled = zip(*rows)
        return pa.record_batch(
            [*(batch.column(c) for c in kept), pa.array(base, fields(pa.string())), pa.array(more_, fields(pa.list_(pa.string()))),
             pa.array(labelled, pa.list_(pa.struct([("w", pa.string()), ("y", pa.int32())])))], [*kept, "base", "found", "labelled"])

    return map_batches(picked, run, ", ".join(f"`{c}` {types[c]}" for c in kept) +
                       ", base array<struct<s:long,e:long,k:string>>, found array<struct<s:long,e:long,k:array<string>>>, labelled array<struct<w:string,y:int>>")


def scan(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", *more: str,
         labelled: int = 2000, recall: float = 0.95, seed: int = 7) -> DataFrame:
    """Per row of ``docs``: the id, ``more`` and ``spans``, an array of (s, e, k): code points, end exclusive, kind.

    At most ``labelled`` different findings of the corpus with either label train the network (those with the smallest hashes), beside as
    many generated ones. NULL and empty texts have no spans; repeated rows and NULL ids are kept;
    spans of the patterns are never lost, whatever the network says.
    """
    table = stage(findings_of(docs, id_column, text_column, *more), "findings")
    one = table.where(F.size("labelled") > 0).select(F.explode("labelled").alias("l")).select("l.*").distinct()
    sample = [(r.w, r.y) for y in (1, 0) for r in one.where(F.col("y") == y).orderBy(F.xxhash64("w"), "w").limit(labelled).collect()]
    net = train(sample + generated_findings(labelled, seed), recall, seed=seed)
    kept, types = [id_column, *more], dict(table.dtypes)

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        base, found = batch.column("base").to_pylist(), batch.column("found").to_pylist()
        texts = [w for row in found for c in row for w in c["k"]]
        sure, at, out = net.probability(texts), 0, []
        for spans, row in zip(base, found):
            all_spans = [(s["s"], s["e"], s["k"]) for s in spans]
            for c in row:
                if sure[at:at + len(c["k"])].max() >= net.threshold:
                    all_spans.append((c["s"], c["e"], "model"))
                at += len(c["k"])
            all_spans.sort(key=lambda s: (s[0], KINDS.index(s[2])))
            out.append([{"s": a, "e": b, "k": k} for a, b, k in all_spans])
        kind = pa.list_(pa.struct([("s", pa.int64()), ("e", pa.int64()), ("k", pa.string())]))
        return pa.record_batch([*(batch.column(c) for c in kept), pa.array(out, kind)], [*kept, "spans"])

    return map_batches(table, run, ", ".join(f"`{c}` {types[c]}" for c in kept) + ", spans array<struct<s:long,e:long,k:string>>")


def joined(spans: list[Span]) -> str:
    return ",".join(f"{k}:{a}:{b}" for a, b, k in spans)


def sha256(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def redact(docs: DataFrame, spans: DataFrame, key: list[str], text_column: str = "text", mark: str = "[secret]") -> DataFrame:
    """``docs`` with every span of ``spans`` (one row per value of ``key``) replaced by ``mark``; overlapping spans become one.

    Only rows with a span pass through Python. Columns and their order stay.
    """
    some = spans.where(F.size("spans") > 0).select(*key, "spans").dropDuplicates(key)
    same = [docs[k].eqNullSafe(some[k]) for k in key]
    together = docs.join(some, same, "left").select(*(docs[c] for c in docs.columns), "spans")
    return cut_out(together, text_column, mark).select(*docs.columns)


def cut_out(df: DataFrame, text_column: str, mark: str) -> DataFrame:
    """``df`` with the code points of its array ``spans`` (sorted by start) replaced by ``mark``, natively."""
    merged = F.aggregate("spans", F.array().cast("array<struct<s:long,e:long>>"), lambda got, x: F.when(
        (F.size(got) > 0) & (F.element_at(got, -1)["e"] >= x["s"]),
        F.concat(F.slice(got, 1, F.size(got) - 1), F.array(F.struct(
            F.element_at(got, -1)["s"].alias("s"), F.greatest(F.element_at(got, -1)["e"], x["e"]).alias("e")))),
    ).otherwise(F.concat(got, F.array(F.struct(x["s"].alias("s"), x["e"].alias("e"))))))
    text = F.col(text_column)
    parts = F.transform("_cut", lambda x, i: F.concat(
        F.substring(text, F.when(i == 0, F.lit(1)).otherwise(F.element_at("_cut", F.greatest(i, F.lit(1)))["e"] + 1).cast("int"),
                    (x["s"] - F.when(i == 0, F.lit(0)).otherwise(F.element_at("_cut", F.greatest(i, F.lit(1)))["e"])).cast("int")), F.lit(mark)))
    rest = F.substring(text, (F.element_at("_cut", -1)["e"] + 1).cast("int"), F.length(text))
    out = df.withColumn("_cut", F.when(F.size("spans") > 0, merged))
    return out.withColumn(text_column, F.when(F.col("_cut").isNull(), text).otherwise(F.concat(F.array_join(parts, ""), rest))).drop("_cut", "spans")
