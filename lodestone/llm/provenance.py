"""Files that nobody wrote by hand here: generated, minified, vendored, data saved as code."""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator
from math import log2

import pyarrow as pa
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.llm.common import text_batches, written

#: Labelled files the forest is fitted on at most; all files are scored.
TRAIN_FILES = 12_000
TREES, DEPTH = 40, 8
#: Share of the trees that must call a file machine-made.
VOTE = 0.75
#: Files whose code is literals by at least this share serve as examples of data, as data bears no notices.
DATA_SHARE = 0.6

#: Notices that tools and copied projects leave in comments.
GENERATED_NOTICE = re.compile(
    r"generated (?:by|from|using|with)\b|\bauto-?generated\b|(?<!\w)@generated\b|machine[- ]generated|\bgenerated (?:file|code)\b|do not (?:edit|modify)|produced by .+ from |edits? (?:are|will be) (?:overwritten|lost)|changes (?:will be|are) (?:lost|overwritten)"
    r"|(?:maschinell|automatisch) (?:erzeugt|generiert|erstellt)|generado automáticamente|generada automáticamente|(?:généré|créé)e? automatiquement|ne pas modifier",
    re.I,
)
COPIED_NOTICE = re.compile(r"copied verbatim from|\blocal copy of\b|imported from the .+ project|\bvendored from\b|third[- ]party source\b|\bunmodified (?:copy|sources?)\b|see LICENSE[.-]\w"
    r"|übernommen aus|kopiert (?:aus|von)|copié(?:e)? (?:de|depuis|du)\b|repris(?:e)? (?:de|du)\b|copiado (?:de|del)\b|tomado (?:de|del)\b|importado (?:de|del)\b", re.I)
MINIFIED_NOTICE = re.compile(r"^/\*!|sourceMappingURL=", re.I)
OWNER_NOTICE = re.compile(r"copyright (?:\(c\) )?(?:\d{4} )?the ([\w.-]+) (?:contributors|authors)", re.I)

#: Path parts that say the same.
VENDORED_PATH = r"(?:^|/)(?:vendor|third_party|third-party|thirdparty|extern|external|deps|bower_components|jspm_packages|node_modules|_vendor|Godeps|Carthage|Pods|site-packages)/"
GENERATED_PATH = r"(?:^|/)(?:gen|generated|__generated__|autogen)/|(?:^|/)zz_generated[_.]|_pb2(?:_grpc)?\.\w+$|_grpc\.\w+$|\.pb\.\w+$|\.(?:generated|g|designer|gen)\.\w+$"
MINIFIED_PATH = r"[.-]min\.\w+$"

_COMMENT = re.compile(r"^[ \t]*(?://|#(?![\[!]|include|define|if|endif|pragma|else|undef)|--|/\*|\*(?=[ /]|$)|<!--|>|;).*$", re.M)
_NAME = re.compile(r"[^\W\d]\w*")
_NUMBER = re.compile(r"\b(?:0x[0-9a-fA-F]+|\d[\d_.]*(?:e[+-]?\d+)?)\b,?")
_LONG = re.compile(r"[A-Za-z0-9+/=]{48,}|(?:\\x[0-9a-fA-F]{2}){8,}|[0-9a-fA-F]{32,}")
_WORD = re.compile(r"\w+")
_STRING = re.compile(r"\"[^\"\n]*\"|'[^'\n]*'")

SUMS = ["n_bytes", "z_bytes", "n_lines", "n_names", "name_chars", "short_names", "entropy", "comment_bytes", "number_bytes", "long_bytes", "space_bytes", "shapes", "string_bytes"]
RATIOS = ["compression", "entropy_mean", "name_length", "short_share", "comment_density", "number_share", "long_share", "space_share", "shape_share", "string_share", "line_length", "line_max", "literal_share", "literal_bytes"]
#: What the path says, as further features.
PATH_FLAGS = ["path_vendored", "path_generated", "path_minified", "path_told"]


def _measured(text: str, owner: str) -> list:
    """Sums over one chunk without its notices, its longest line, and what the notices say."""
    if "\r" in text:
        text = text.replace("\r\n", "\n").replace("\r", "\n")
    notice, own, kept, at, comment = 0, 0, [], 0, 0
    for m in _COMMENT.finditer(text):
        line = m[0]
        kept.append(text[at : m.start()])
        at = m.end()
        hidden, bare, end = False, line.strip(), len(line)
        closing = "*/" if bare.startswith(("/*", "*")) else "-->" if bare.startswith("<!--") else None
        if closing and closing in line:  # code may stand behind the comment's end
            end = line.index(closing) + len(closing)
            bare = line[:end].strip()
        if GENERATED_NOTICE.search(bare):
            notice, hidden = notice | 1, True
        elif COPIED_NOTICE.search(bare):
            notice, hidden = notice | 2, True
        elif MINIFIED_NOTICE.search(bare):
            notice, hidden = notice | 4, True
        elif who := OWNER_NOTICE.search(bare):
            hidden = True
            if who[1].lower() == owner:
                own = 1
            else:
                notice |= 8
        kept.append(line[end:])
        if not hidden:
            comment += end
    kept.append(text[at:])
    code = "".join(kept)
    data = code.encode("utf-8", "surrogatepass")
    names = _NAME.findall(code)
    lines = [x for x in code.split("\n") if x and not x.isspace()]
    n = len(names)
    counts = Counter(names)
    entropy = -sum(c * log2(c / n) for c in counts.values()) if n else 0.0
    longs = sum(map(len, _LONG.findall(code)))
    return [
        len(data),
        len(zlib.compress(data, 1)) if data else 0,
        len(lines),
        n,
        sum(map(len, names)),
        sum(len(x) < 3 for x in names),
        entropy,
        comment,
        sum(map(len, _NUMBER.findall(code))),
        longs,
        code.count(" ") + code.count("\t"),
        len({_WORD.sub("w", x.strip()) for x in lines}),
        sum(map(len, _STRING.findall(code))),
        max(map(len, lines), default=0),
        notice,
        own,
    ]


def file_measures(chunks: DataFrame) -> DataFrame:
    """One row per file: sums over its distinct chunks, ratios, and the notices found.

    Chunks are measured where they are read; only numbers are shuffled, first by
    chunk (to count repeated rows once), then pre-aggregated by file.
    """
    numbers = [f"{c} double" for c in SUMS] + ["line_max double", "notice int", "own int"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_batches(batches, 2 << 20):
            owners = [(r or "").lower() for r in batch.column(0).to_pylist()]
            rows = [_measured(text or "", owner) for text, owner in zip(batch.column(3).to_pylist(), owners)]
            columns = list(zip(*rows))
            arrays = [pa.array(c, pa.float64()) for c in columns[:-2]] + [pa.array(c, pa.int32()) for c in columns[-2:]]
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], *arrays], names=["repo", "file_path", "chunk_id", *SUMS, "line_max", "notice", "own"])

    rows = chunks.select("repo", "file_path", F.col("chunk_id").cast("bigint").alias("chunk_id"), "content").where("file_path is not null")
    measured = rows.mapInArrow(run, "repo string, file_path string, chunk_id bigint, " + ", ".join(numbers))
    once = measured.groupBy("repo", "file_path", "chunk_id").agg(*[F.max(c).alias(c) for c in [*SUMS, "line_max", "notice", "own"]])
    files = once.groupBy("repo", "file_path").agg(*[F.sum(c).alias(c) for c in SUMS], F.max("line_max").alias("line_max"), F.bit_or("notice").alias("notice"), F.max("own").alias("own"))

    def share(a: str, b: str) -> Column:
        return F.when(F.col(b) > 0, F.col(a) / F.col(b)).otherwise(0.0)

    return files.select(
        "repo", "file_path", "notice", "own", "n_bytes",
        share("z_bytes", "n_bytes").alias("compression"), share("entropy", "n_names").alias("entropy_mean"), share("name_chars", "n_names").alias("name_length"),
        share("short_names", "n_names").alias("short_share"), (F.col("comment_bytes") / (F.col("n_bytes") + F.col("comment_bytes") + 1)).alias("comment_density"),
        share("number_bytes", "n_bytes").alias("number_share"), share("long_bytes", "n_bytes").alias("long_share"), share("space_bytes", "n_bytes").alias("space_share"),
        share("shapes", "n_lines").alias("shape_share"), share("string_bytes", "n_bytes").alias("string_share"), share("n_bytes", "n_lines").alias("line_length"), "line_max",
        F.when(F.col("n_bytes") > 0, (F.col("number_bytes") + F.col("long_bytes")) / F.col("n_bytes")).otherwise(0.0).alias("literal_share"), (F.col("number_bytes") + F.col("long_bytes")).alias("literal_bytes"),
        *[F.col("file_path").rlike(pattern).cast("double").alias(name) for name, pattern in zip(PATH_FLAGS, (VENDORED_PATH, GENERATED_PATH, MINIFIED_PATH, f"{VENDORED_PATH}|{GENERATED_PATH}|{MINIFIED_PATH}"))],
    )


def machine_made(chunks: DataFrame, train_files: int = TRAIN_FILES, vote: float = VOTE) -> DataFrame:
    """Every file with the forest's vote on it: ``repo, file_path, notice, probability, by_vote, machine_made`` and the features.

    A random forest is trained on files labelled by their header notices (a tool's
    notice, a copy's or another owner's: machine-made; the repository's own licence
    header and no notice: hand-written), with the notices hidden from its features,
    on files of literals only, as data bears no notice, and on files whose path names
    a tool or a folder for copies, which teach it what the path is worth. Features are measures of
    the text and what the path says. It scores every file and decides all that bear
    no notice (``by_vote``); a file with a notice keeps what the notice says.

    Empty files have a row and are hand-written unless their path decides otherwise;
    a null repository is a repository of its own; files without a path are
    ignored. Without labelled files of both kinds the vote is 0 for all files.
    """
    files = written(file_measures(chunks), "files")
    data = (F.col("literal_share") >= DATA_SHARE) & (F.col("notice") == 0)
    # a copy looks like any hand-written file, so copies are examples only where their path says so
    told = (F.col("path_told") == 1) & (F.col("own") == 0)
    label = F.when((F.col("notice").bitwiseAND(5) != 0) | told | data, 1.0).when((F.col("notice") == 0) & (F.col("own") == 1), 0.0)
    labelled = files.withColumn("label", label).where("label is not null and n_bytes > 0")
    counts = {r[0]: r[1] for r in labelled.groupBy("label").count().collect()}
    features = VectorAssembler(inputCols=RATIOS + PATH_FLAGS, outputCol="features", handleInvalid="keep")
    if len(counts) == 2:
        # the same number of either kind at most, chosen by a hash of the path
        def chosen(v: float) -> DataFrame:
            hashed = F.xxhash64("repo", "file_path")
            share = min(1.0, train_files / counts[v])  # thins the rows to about twice the number before they are gathered
            return labelled.where((F.col("label") == v) & (F.pmod(hashed, F.lit(1 << 20)) < max(1, int(share * (1 << 20))))).orderBy(hashed).limit(train_files // 2)

        part = [chosen(0.0), chosen(1.0)]
        n = {v: min(c, train_files // 2) for v, c in counts.items()}
        train = part[0].unionByName(part[1]).withColumn("weight", F.when(F.col("label") == 1.0, sum(n.values()) / n[1.0]).otherwise(sum(n.values()) / n[0.0]))
        train = written(train.coalesce(1), "labelled")
        forest = RandomForestClassifier(numTrees=TREES, maxDepth=DEPTH, seed=11, weightCol="weight", featureSubsetStrategy="sqrt", subsamplingRate=0.8)
        model = forest.fit(features.transform(train))
        scored = model.transform(features.transform(files)).withColumn("vote", vector_to_array("probability")[1]).drop("probability")
    else:
        scored = files.withColumn("vote", F.lit(0.0))
    by_vote = (F.col("notice") == 0) & (F.col("vote") >= vote)
    return scored.select("repo", "file_path", "notice", F.col("vote").alias("probability"), by_vote.alias("by_vote"), ((F.col("notice") != 0) | by_vote).alias("machine_made"), *RATIOS, *PATH_FLAGS, "n_bytes", "own")
