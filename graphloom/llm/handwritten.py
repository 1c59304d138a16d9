"""Generated, packed, third-party and data files among source files, so that hand-written source remains.

Three linear support-vector classifiers judge every file: on hashed character n-grams of its text, giveaway comments at its
edges being masked, on those of these comments, and on hashed path components. Giveaways (what generators write on top,
folder and file names, packed or literal-only layout) label the bounded sample they are trained on. Their thresholds are
those at which files of repositories held out from training are told apart with the wanted precision. Copies of upstream
files are found by shingles, as they look like any other code.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.operators.latest import latest_per_key
from graphloom.session import hinted, materialize, spread

#: Hashed features of a classifier.
FEATURES = 1 << 17
#: Labelled files of each class that a classifier is trained on at most; those with the smallest hashes are taken.
TRAINING = 2000
#: Share of repositories held out; the precision wanted on them of what a classifier is sure of, and the share of
#: giveaways there that it must find likely.
HELD_OUT, PRECISION, RECALL = 0.25, 0.995, 0.99
#: Shingles of so many words; similarity from which a file counts as a copy of an upstream file. TESTDATA's cases include
#: patched copies, so this is below the usual 0.8.
SHINGLE, SIMILAR = 5, 0.6
#: Bits of the bitmap of upstream shingles.
BUCKETS = 1 << 22

# What labels the training sample: folders for code of others or of tools, and endings of such files' names.
FOLDERS = set("vendor third_party third-party thirdparty 3rdparty node_modules bower_components extern external deps generated __generated__ autogen gen dist out intermediate".split())
ENDINGS = re.compile(r"([.-]min\.[cm]?js|\.bundle\.[cm]?js|\.gen\.\w+|\.generated\.\w+|[._-]generated\.\w+|\.g\.cs|\.designer\.cs|\.pb\.\w+|_pb2\.pyi?)$", re.I)
# What labels the training sample: what generators write on top of their files, in several languages.
HEADERS = re.compile(
    r"generated (by|with|from|code|file)|generated-by|@generated|auto-?generated|machine-?(made|written|generated)|regenerate with"
    r"|(automatically|auto-?) ?(created|generated|produced|written)|(created|produced|emitted|made|written) (with|by|from) \S+ ?(\(|from|[\d.v]+\b|in |on )"
    r"|do not (modify|touch)\b|edit \S+ instead|\b(hand|manual|local) (edits|changes|modifications)\b.*(lost|overwritten)"
    r"|\boutput(, | of `)|\bsource: .*\bcompiler: |build artifact"
    r"|automatisch aus .* erzeugt|(généré|produit)e?s? par|ne pas modifier|создан программой|сгенерирован|не редактировать|自動生成|自动生成"
    r"|wygenerowan|generado (por|automáticamente)|gerado (por|automaticamente)",
    re.I,
)

_DIGITS = bytes(48 if 48 <= i < 58 else i for i in range(256))
_COMMENT = re.compile(r"(//|/\*|\*|#(?!include|!|pragma|if|define|endif)|--)")
_NAMES = re.compile(r"[^\W\d]\w*|\d[\w.]*")
_WORDS = re.compile(r"[^\W\d]\w*|\d[\w.]*|[^\s\w]")
_STRING = re.compile(r"\"(?:[^\"\\\n]|\\.)*(?:\"|\\?\Z)|'(?:[^'\\\n]|\\.)*(?:'|\\?\Z)|`(?:[^`\\]|\\.)*`")
_NOTES = re.compile(r"/\*.*?\*/|\"\"\".*?\"\"\"|(?m:^[ \t]*(?://|#(?!include|define|pragma|if|endif)|--)[^\n]*)|[ \t]//[^\n]*", re.S)


def edge_comments(text: str) -> tuple[list[str], str]:
    """(comment lines before the first and after the last line of code, not indented ones within), and the text without."""
    lines = text.lstrip("\ufeff").splitlines()

    def run(numbers: Iterator[int]) -> list[int]:
        taken, inside = [], False
        for i in numbers:
            s = lines[i].strip()
            if not s or s.startswith("#!"):
                continue
            if not inside and not _COMMENT.match(s):
                break
            taken.append(i)
            inside = inside and "*/" not in s or s.startswith("/*") and "*/" not in s
        return taken

    top = run(iter(range(len(lines))))
    tail = []
    for i in range(len(lines) - 1, top[-1] if top else -1, -1):
        s = lines[i].strip()
        if s and (lines[i][0].isspace() and not s.startswith("*") or not (_COMMENT.match(s) or s == "*/")):
            break
        if s:
            tail.append(i)
    edge = {*top, *tail}
    return [lines[i] for i in sorted(edge)], "\n".join(x for i, x in enumerate(lines) if i not in edge)


def shingles(text: str) -> np.ndarray:
    """Distinct hashes of SHINGLE consecutive words of a text without comments; layout doesn't matter."""
    words = _WORDS.findall(_NOTES.sub(" ", text))
    if len(words) < SHINGLE:
        return np.zeros(0, np.int64)
    if len(_known) > 200_000:
        _known.clear()
    codes = np.array([_known[w] if w in _known else _known.setdefault(w, int.from_bytes(hashlib.blake2b(w.encode("utf-8", "replace"), digest_size=8).digest(), "little")) for w in words], dtype=np.uint64)
    h = np.zeros(len(words) - SHINGLE + 1, np.uint64)
    for i in range(SHINGLE):
        h = (h ^ (h >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15) + codes[i : len(words) - SHINGLE + 1 + i]
    return np.unique(h ^ (h >> np.uint64(29))).view(np.int64)


#: Hashes of words that a worker remembers.
_known: dict[str, int] = {}


def layout(code: str) -> str | None:
    """`data` if a text without comments is hardly more than literals, `packed` if it was made to have few lines."""
    if not code.strip():
        return None
    holes = _STRING.sub("\0", code)
    strings = holes.count("\0")
    words = _NAMES.findall(holes)
    names = sum(not w[0].isdigit() for w in words)
    literal = len(code) - len(holes) + strings + sum(len(w) for w in words if w[0].isdigit()) + strings
    if len(code) > 150 and literal > 0.3 * len(code) and (len(words) + strings and names <= max(4, 0.12 * (len(words) + strings)) or names <= 8 and literal > 0.7 * len(code)):
        return "data"
    bare = holes.replace("\0", " 0 ")
    long = sum(len(x) for x in bare.split("\n") if len(x) > 250)
    if long > 0.6 * len(bare) and sum(map(bare.count, "{}()[];=")) > 0.06 * len(bare):
        return "packed"
    return None


def has_code(text: str) -> bool:
    """Whether a text has more than blanks and notes."""
    start = text.lstrip()[:1]
    return bool(start) and (start not in "/#-\"" or bool(_NOTES.sub("", text).strip()))


def prose(text: str) -> bool:
    """Whether a text hardly has the marks, quotes and digits of code or data; such a text is no code to be judged."""
    return sum(map(text.count, '{}()[];="`')) < 0.015 * len(text) and sum(map(text.count, "0123456789")) < 0.12 * len(text)


def path_giveaway(path: str | None) -> str | None:
    parts = (path or "").replace("\\", "/").lower().split("/")
    return "folder" if FOLDERS.intersection(parts[:-1]) else "name" if ENDINGS.search(parts[-1]) else None


def ngrams(text: str) -> np.ndarray:
    """The distinct hashes below FEATURES of the 3- to 5-grams of a text, runs of digits being one zero. Blanks have none."""
    if not text.strip():
        return np.zeros(0, np.int32)
    b = np.frombuffer(text.encode("utf-8", "replace").translate(_DIGITS), dtype=np.uint8)
    b = b[np.append(True, (b[1:] != 48) | (b[:-1] != 48))].astype(np.uint32)
    seen = np.zeros(FEATURES, dtype=bool)
    h = b
    for n in range(2, 6):
        if len(b) < n:
            break
        h = h[:-1] * np.uint32(16777619) ^ b[n - 1 :] * np.uint32(2654435761)
        if n >= 3:
            seen[(h ^ (h >> np.uint32(15))) & np.uint32(FEATURES - 1)] = True
    return np.flatnonzero(seen).astype(np.int32)


_PIECE = re.compile(r"(?:^|[._-])[^._-]+(?=([._-]|$))")


def path_features(path: str | None) -> np.ndarray:
    """Hashes of a path's components, alone and with their neighbour, and of the pieces of its file name, with the signs that
    stand before and after them (`.min.` is not `min_`), and of its endings."""
    parts = [p for p in (path or "").replace("\\", "/").lower().split("/") if p not in ("", ".")]
    name = parts[-1] if parts else ""
    pieces = [m.group() + m.group(1) for m in _PIECE.finditer(name)]
    words = [f"d:{p}" for p in parts[:-1]] + [f"n:{a}/{b}" for a, b in zip(parts, parts[1:-1])] + [f"f:{p}" for p in pieces] + [f"s:{name[i:]}" for i, c in enumerate(name) if c in "._-"]
    return np.unique(np.array([zlib.crc32(w.encode("utf-8", "replace")) % FEATURES for w in words], dtype=np.int32))


@dataclass
class Classifier:
    """A linear classifier of hashed features. A file whose score reaches `sure` is reported; one with a giveaway is reported
    from `likely` on. Untrained, it has a score of 0 for all, is never sure and finds any giveaway likely."""

    weights: np.ndarray
    bias: float = 0.0
    sure: float = float("inf")
    likely: float = float("-inf")

    def score(self, features: np.ndarray) -> float:
        """Minus infinity without features: there is nothing to judge."""
        if not len(features):
            return float("-inf")
        return float(self.weights[features].sum() / len(features) ** 0.5 + self.bias)


def train(rows: list[np.ndarray], labels: np.ndarray, held_out: np.ndarray, epochs: int = 12, penalty: float = 1e-5) -> Classifier:
    """A linear support-vector classifier by stochastic subgradients on the hinge loss, the classes weighing the same. On
    the held-out rows, `sure` is the lowest threshold (at least 0) with PRECISION, and `likely` lets RECALL of the positives
    pass. Fewer than 10 rows of a class to train on: an untrained classifier."""
    model = Classifier(np.zeros(FEATURES, np.float32))
    used = np.flatnonzero(~held_out)
    positive = int(labels[used].sum())
    if min(positive, len(used) - positive) < 10:
        return model
    balance = {1: len(used) / (2 * positive), 0: len(used) / (2 * (len(used) - positive))}
    rng = np.random.default_rng(0)
    mean, mean_bias, w, bias, t = np.zeros(FEATURES), 0.0, model.weights, 0.0, 0
    for epoch in range(epochs):
        for i in rng.permutation(used):
            t += 1
            f = rows[i]
            norm = max(1.0, len(f)) ** -0.5
            y = 1.0 if labels[i] else -1.0
            if y * (w[f].sum() * norm + bias) < 1:
                step = y * balance[int(labels[i])] / (1 + penalty * 100 * t) * 0.5
                w[f] += step * norm
                bias += step * 0.1
        w *= 1 - penalty * len(used)
        if epoch >= epochs // 2:
            mean += w
            mean_bias += bias
    n = epochs - epochs // 2
    model.weights, model.bias = (mean / n).astype(np.float32), mean_bias / n
    check = np.flatnonzero(held_out)
    scores = np.array([model.score(rows[i]) for i in check])
    order = np.argsort(-scores)
    hits = np.cumsum(labels[check][order])
    good = [scores[order[k]] for k in range(len(order)) if scores[order[k]] > 0 and hits[k] >= PRECISION * (k + 1)]
    model.sure = max(0.0, min(good)) if good else float("inf")
    passed = np.sort(scores[labels[check].astype(bool) & np.isfinite(scores)])
    if len(passed):
        model.likely = min(model.sure, float(passed[int((1 - RECALL) * len(passed))]))
    return model


def _signals(buckets: np.ndarray):
    """Per text: what gives it away, whether it has comments at its edges and, if as many of its shingles are in the buckets
    as a copy of an upstream file must share, its shingles."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for text in batch["content"]:
                edge, code = edge_comments(text)
                bare = _NOTES.sub("", code)
                marks = shingles(text)
                shared = buckets[marks & (len(buckets) - 1)] if len(buckets) else np.zeros(0, bool)
                close = len(marks) > 0 and shared.sum() >= SIMILAR * len(marks)
                rows.append(("header" if any(HEADERS.search(x) for x in edge) else layout(bare), bool(edge), bool(bare.strip()) and not prose(code), len(marks), marks[shared] if close else None))
            yield pd.DataFrame({"sha256": batch["sha256"], **{n: [r[i] for r in rows] for i, n in enumerate(("signal", "noted", "coded", "n_marks", "marks"))}})

    return run


def _upstream_marks(upstream: DataFrame) -> DataFrame:
    """file, n_marks and mark: the shingles of each upstream text once."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            marks = [shingles(x) for x in batch["content"]]
            yield pd.DataFrame({"file": batch["file"], "n_marks": [len(x) for x in marks], "marks": marks})

    texts = upstream.where("content is not null").select("content").distinct().select(F.sha2("content", 256).alias("file"), "content")
    return texts.mapInPandas(run, "file string, n_marks long, marks array<long>").select("file", "n_marks", F.explode("marks").alias("mark"))


def text_signals(texts: DataFrame, upstream: DataFrame) -> DataFrame:
    """Per text (sha256, content): sha256, signal (`copy` of an upstream file, `header`, `data`, `packed` or null), noted (has
    comments at its edges) and coded (has code to be judged).

    A copy shares SIMILAR of its distinct shingles with one upstream file, of both files' together. A bitmap of fixed size of
    all upstream shingles tells which texts may; only their shingles are joined with those of the upstream files, so
    upstream may have any number of files.
    """
    marks = materialize(_upstream_marks(upstream))
    buckets = np.zeros(BUCKETS, dtype=bool)
    bucket = F.col("mark").bitwiseAND(F.lit(BUCKETS - 1)).cast("int")
    for r in marks.select(F.shiftright(bucket, 16).alias("h"), bucket.alias("b")).distinct().groupBy("h").agg(F.collect_list("b").alias("b")).toLocalIterator():
        buckets[r["b"]] = True
    session = texts.sparkSession
    held = session.sparkContext.broadcast(buckets)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        return _signals(held.value)(batches)

    seen = materialize(texts.select("sha256", "content").mapInPandas(run, "sha256 string, signal string, noted boolean, coded boolean, n_marks long, marks array<long>"))
    own = seen.where("marks is not null").select("sha256", F.col("n_marks").alias("n"), F.explode("marks").alias("mark"))
    pairs = own.join(marks, "mark").groupBy("sha256", "file").agg(F.count("*").alias("k"), F.first("n").alias("n"), F.first("n_marks").alias("m"))
    copies = pairs.where(F.col("k") >= SIMILAR * (F.col("n") + F.col("m") - F.col("k"))).select("sha256").distinct().withColumn("_copy", F.lit("copy"))
    return seen.drop("marks", "n_marks").join(copies, "sha256", "left").withColumn("signal", F.coalesce("_copy", "signal")).drop("_copy")


def _sample(files: DataFrame, label: str) -> DataFrame:
    """The TRAINING rows of each class with the smallest hashes, over all rows with a label."""
    labelled = files.where(F.col(label).isNotNull()).withColumn("_h", F.xxhash64("id"))
    return labelled.where(label).orderBy("_h").limit(TRAINING).unionByName(labelled.where(~F.col(label)).orderBy("_h").limit(2 * TRAINING))


VIEWS = {"text": lambda row: ngrams(edge_comments(row)[1]), "notes": lambda row: ngrams("\n".join(edge_comments(row)[0])), "path": path_features}


def _fit(sample: DataFrame, label: str, view: str) -> Classifier:
    """Train on a sample: its features are made in parallel, then one task trains, and only the weights reach the driver."""
    column = "path" if view == "path" else "content"

    def features(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame({"project_id": batch["project_id"].fillna(""), "label": batch[label], "features": [VIEWS[view](x).astype(np.int32).tobytes() for x in batch[column]]})

    def fit(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        got = pd.concat([pd.DataFrame({"project_id": [], "label": [], "features": []}), *batches])
        got = got.sort_values(["project_id", "label", "features"])
        held = np.array([zlib.crc32(f"held {p}".encode()) % 1000 < HELD_OUT * 1000 for p in got["project_id"]], dtype=bool)
        model = train([np.frombuffer(f, dtype=np.int32) for f in got["features"]], got["label"].to_numpy(dtype=bool), held)
        yield pd.DataFrame({"weights": [model.weights.tobytes()], "bias": [float(model.bias)], "sure": [float(model.sure)], "likely": [float(model.likely)]})

    rows = sample.select("id", "project_id", label, column).mapInPandas(features, "project_id string, label boolean, features binary").repartition(1)
    r = rows.mapInPandas(fit, "weights binary, bias double, sure double, likely double").first()
    return Classifier(np.frombuffer(bytes(r["weights"]), dtype=np.float32), r["bias"], r["sure"], r["likely"])


def labelled_files(sample_map: DataFrame, texts: DataFrame, upstream: DataFrame) -> DataFrame:
    """The files to be judged, written: id, project_id, path, sha256, giveaway (of the path), signal (of the text), noted,
    coded, has_text, and by view the label of files that may be trained on: by_text, by_notes, by_path."""
    current = latest_per_key(sample_map, ["id"], ["delivered_at"], ["project_id", "path", "category", "included", "sha256"])
    wanted = current.where("included and lower(trim(category)) = 'source'").select("id", "project_id", "path", "sha256")

    def by_path(paths: pd.Series) -> pd.Series:
        return paths.map(path_giveaway)

    wanted = materialize(wanted.withColumn("giveaway", F.pandas_udf(by_path, "string")("path")))
    needed = materialize(wanted.where("sha256 is not null").select("sha256").distinct(), measured=True)
    some = spread(texts.where("length(content) > 0").select("sha256", "content")).join(hinted(needed), "sha256", "left_semi")
    signals = text_signals(some, upstream)
    files = wanted.join(signals.withColumn("has_text", F.lit(True)), "sha256", "left")
    if "sha256" in upstream.columns:
        hashes = upstream.where("sha256 is not null").select(F.lower("sha256").alias("_hash")).distinct()
        files = files.join(hashes.withColumn("_exact", F.lit("copy")), F.lower("sha256") == F.col("_hash"), "left")
        files = files.withColumn("signal", F.coalesce("_exact", "signal")).drop("_hash", "_exact")
    clean = F.col("has_text") & F.col("signal").isNull() & F.col("giveaway").isNull()
    odd = F.col("signal").isin("header", "data", "packed") | F.col("giveaway").eqNullSafe("name") & F.col("has_text")
    files = files.withColumn("has_text", F.coalesce("has_text", F.lit(False)))
    # copies and files in others' folders look like any other code, so their texts teach nothing
    return materialize(files.select(
        "id", "project_id", "path", "sha256", "giveaway", "signal", "has_text",
        F.when(F.coalesce("coded", F.lit(False)) | odd, F.when(F.coalesce(odd, F.lit(False)), True).when(clean, False)).alias("by_text"),
        F.when(F.col("noted"), F.when(F.col("signal") == "header", True).when(clean, False)).alias("by_notes"),
        F.when(F.col("giveaway").isNotNull(), True).when(clean, False).alias("by_path"),
    ))


def find_not_handwritten(sample_map: DataFrame, texts: DataFrame, upstream: DataFrame) -> DataFrame:
    """Included source files that aren't hand-written for their repository: source_id, project_id, path, reason.

    sample_map: the current row of an id is the one with the latest delivered_at; its category must be `source`, case and
    blanks aside, and included true. texts: sha256, content (one row per hash). upstream: content, sha256 if known.

    Three classifiers judge every file, trained on a sample that giveaways label: of its text without the comments at its
    edges (reason `text`), of these comments (`notes`), of its path (`path`). Where none is sure, an exact check follows: a
    giveaway (`header`, `data`, `packed`, `folder`, `name`) counts if its classifier finds it likely. Copies of upstream
    files are found by their shingles or, having no text, by their hash, its case aside (`copy`). Files without text, or
    with an empty one, count by their path. All files are judged; only the training samples are bounded.
    """
    files = labelled_files(sample_map, texts, upstream)
    session = files.sparkSession
    contents = texts.where("length(content) > 0").select("sha256", "content")
    models = {}
    for view in VIEWS:
        sample = materialize(_sample(files, f"by_{view}").select("id", "project_id", "path", "sha256", f"by_{view}"))
        if view != "path":  # at most 3 x TRAINING rows
            sample = contents.join(F.broadcast(sample), "sha256")
        models[view] = _fit(sample, f"by_{view}", view)
    trained = session.sparkContext.broadcast(models)

    def judge_texts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        text, notes = trained.value["text"], trained.value["notes"]
        for batch in batches:
            rows = []
            for content in batch["content"]:
                edge, code = edge_comments(content)
                bare = has_code(code)
                a = text.score(ngrams(code)) if bare and not prose(code) else float("-inf")
                b = notes.score(ngrams("\n".join(edge))) if edge else float("-inf")
                rows.append(("notes" if b >= notes.sure else "text" if a >= text.sure else None, a >= text.likely or not bare, b >= notes.likely))
            yield pd.DataFrame({"sha256": batch["sha256"], **{n: [r[i] for r in rows] for i, n in enumerate(("said", "text_likely", "notes_likely"))}})

    def judge_paths(paths: pd.Series) -> pd.DataFrame:
        model = trained.value["path"]
        scores = [model.score(path_features(p)) for p in paths]
        return pd.DataFrame({"sure": [s >= model.sure for s in scores], "likely": [s >= model.likely for s in scores]})

    needed = materialize(files.where("has_text").select("sha256").distinct(), measured=True)
    judged = spread(contents).join(hinted(needed), "sha256", "left_semi").mapInPandas(judge_texts, "sha256 string, said string, text_likely boolean, notes_likely boolean")
    both = files.join(judged, "sha256", "left").withColumn("on_path", F.pandas_udf(judge_paths, "sure boolean, likely boolean")("path"))
    exact = F.when((F.col("signal") == "header") & F.col("notes_likely"), "header").when(F.col("signal").isin("data", "packed") & F.col("text_likely"), F.col("signal"))
    exact = F.coalesce(exact, F.when(F.col("on_path.likely"), F.col("giveaway")))
    reason = F.coalesce(F.when(F.col("signal") == "copy", "copy"), "said", F.when(F.col("on_path.sure"), "path"), exact)
    return both.select(F.col("id").alias("source_id"), "project_id", "path", reason.alias("reason")).where("reason is not null")
