"""Secret scan with corpus-wide ownership frequency.

Each text is scanned once for base matches (``assign``, ``access``, ``hex``)
and for generic random-looking tokens.  Every matched value becomes a
candidate; its hash is counted over the corpus by distinct repository, owner
and document.  A value that several owners hold is a widely *copied* example;
a random-looking value held by few owners is *owned*: a live-looking
credential.  Owned values add ``owned`` spans; base spans always stay.

Only candidates are shuffled (never texts), pre-aggregated by (hash, owner,
repository) before they meet.  The join that brings the counts back is a plain
equi-join, whose hot values the adaptive skew join splits.

Defined cases: a null text has no spans; a null repository counts as one
unnamed repository; the same value twice in one document counts once; empty
tables give empty results; other columns are ignored (or passed on unchanged
by :func:`redact`).
"""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cartlift.llm.common import materialize

KINDS = ("assign", "access", "hex", "owned")
ORDER = {k: i for i, k in enumerate(KINDS)}

ASSIGN = re.compile(
    r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ASSIGN_WORDS = ("password", "passwd", "secret", "token", "api_key", "apikey")
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{16,}")  # a maximal run of 16 or more, as '[0-9a-f]+' with short matches dropped
GENERIC = re.compile(r"[A-Za-z0-9+/_-]{20,}")

SPAN = T.StructType([T.StructField("kind", T.StringType()), T.StructField("start", T.LongType()),
                     T.StructField("end", T.LongType()), T.StructField("value_start", T.LongType()),
                     T.StructField("value", T.StringType())])
ARROW_SPANS = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()),
                                  ("value_start", pa.int64()), ("value", pa.string())]))


def entropy(value: str) -> float:
    """Shannon entropy of the characters, in bits."""
    n = len(value)
    return -sum(c / n * math.log2(c / n) for c in Counter(value).values()) if n else 0.0


def looks_random(value: str, min_bits: float = 2.5) -> bool:
    return len(value) >= 12 and any(c.isdigit() for c in value) and entropy(value) >= min_bits


def scan_text(text: str | None) -> list[tuple[str, int, int, int, str]]:
    """Spans (kind, start, end, start of the value, value) in code points;
    generic tokens, which are candidates only, have kind ``generic``."""
    if not text:
        return []
    out = []
    low = text.lower()
    if any(w in low for w in ASSIGN_WORDS):
        out += [("assign", m.start(), m.end(), m.start(2), m[2]) for m in ASSIGN.finditer(text) if len(m[2]) >= 12]
    if "AKIA" in text:
        out += [("access", m.start(), m.end(), m.start(), m[0]) for m in ACCESS.finditer(text) if len(m[0]) >= 18]
    out += [("hex", m.start(), m.end(), m.start(), m[0]) for m in HEX.finditer(text)]
    for m in GENERIC.finditer(text):
        v = m[0]
        if (any(c.isdigit() for c in v) and any(c.islower() for c in v) and any(c.isupper() for c in v)
                and entropy(v) >= 3.5):
            out.append(("generic", m.start(), m.end(), m.start(), v))
    return out


def with_spans(docs: DataFrame, text_col: str = "text", out: str = "__spans") -> DataFrame:
    """All rows and columns, with the array of scanned spans appended."""
    at = docs.columns.index(text_col)
    fields = [f for f in docs.schema.fields] + [T.StructField(out, T.ArrayType(SPAN))]

    def scan(batches):
        names = ("kind", "start", "end", "value_start", "value")
        for b in batches:
            texts = b.column(at)
            spans = [[dict(zip(names, s)) for s in scan_text(texts[i].as_py())] for i in range(b.num_rows)]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(spans, ARROW_SPANS)],
                                             names=[*b.schema.names, out])

    return docs.mapInArrow(scan, T.StructType(fields))


def owner_of(repo: Column) -> Column:
    """The part before the first '/' of a repository name, or the whole name."""
    return F.substring_index(repo, "/", 1)


def ownership(candidates: DataFrame) -> DataFrame:
    """Distinct repositories, owners and documents per candidate hash.

    Input: one row per (value_hash, document) with ``repo`` and ``owner``.
    """
    return (candidates.groupBy("value_hash", "owner", "repo").agg(F.count(F.lit(1)).alias("n"))
            .groupBy("value_hash", "owner").agg(F.count(F.lit(1)).alias("repos"), F.sum("n").alias("n"))
            .groupBy("value_hash").agg(F.count(F.lit(1)).alias("n_owners"), F.sum("repos").alias("n_repos"),
                                       F.sum("n").alias("n_docs")))


def classified(found: DataFrame, repo_col: str, max_owners: int) -> DataFrame:
    """Spans with ownership counts and ``status`` (owned, copied or other).

    ``found`` must be written already: columns ``__rid``, ``repo_col``, ``__spans``.
    """
    flat = (found.select("__rid", F.coalesce(F.col(repo_col).cast("string"), F.lit("")).alias("repo"),
                         F.explode("__spans").alias("s"))
            .select("__rid", "repo", owner_of(F.col("repo")).alias("owner"), "s.*",
                    F.sha2(F.col("s.value").cast("binary"), 256).alias("value_hash")))
    counts = ownership(flat.select("__rid", "repo", "owner", "value_hash").distinct())
    random_like = F.udf(lambda v: looks_random(v), "boolean")  # on candidates only, a few rows per thousand documents
    return (flat.join(counts, "value_hash")
            .withColumn("status", F.when(F.col("n_owners") > max_owners, F.lit("copied"))
                        .when(random_like("value"), F.lit("owned")).otherwise(F.lit("other"))))


def scan_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", repo_col: str = "source",
                 max_owners: int = 2) -> DataFrame:
    """Findings per document: id and the array ``findings`` of
    (kind, start, end, value_start, value_hash, status, n_owners, n_repos, n_docs), where an
    owned value has a second entry of kind ``owned`` over the value alone.
    Documents without findings have an empty array."""
    rows = docs.select(F.monotonically_increasing_id().alias("__rid"), F.col(id_col).alias("id"),
                       F.col(repo_col).alias("repo"), F.col(text_col).cast("string").alias("text"))
    found = materialize(with_spans(rows).drop("text"), "secret_spans")
    marked = classified(found, "repo", max_owners)
    fields = ["kind", "start", "end", "value_start", "value_hash", "status", "n_owners", "n_repos", "n_docs"]
    base = marked.where("kind <> 'generic'").select("__rid", *fields)
    owned = (marked.where("status = 'owned'")
             .withColumn("start", F.col("value_start")).withColumn("end", F.col("start") + F.char_length("value"))
             .withColumn("kind", F.lit("owned")).select("__rid", *fields).distinct())
    per_doc = base.unionByName(owned).groupBy("__rid").agg(F.collect_list(F.struct(*fields)).alias("findings"))
    some = found.where(F.size("__spans") > 0).select("__rid", "id").join(per_doc, "__rid", "left")
    none = found.where(F.size("__spans") == 0).select(
        "__rid", "id", F.lit(None).cast(per_doc.schema["findings"].dataType).alias("findings"))
    return some.unionByName(none).select(
        F.col("id").alias(id_col),
        F.coalesce("findings", F.array().cast(per_doc.schema["findings"].dataType)).alias("findings"))


def span_text(findings: list, kinds: tuple[str, ...]) -> str:
    """``kind:start:end`` of the chosen kinds by start, then kind as listed, comma-joined."""
    chosen = sorted({(f["start"], ORDER[f["kind"]], f["end"]) for f in findings if f["kind"] in kinds})
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in chosen)


def digest_spans(found: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Counts and digests per document of :func:`scan_secrets`' findings."""
    schema = T.StructType([found.schema[id_col],
                           *[T.StructField(c, T.LongType()) for c in ("n_assign", "n_access", "n_hex", "n_owned")],
                           T.StructField("base_sha256", T.StringType()), T.StructField("spans", T.StringType())])

    def digest(batches):
        for b in batches:
            ids, lists = b.column(0), b.column(1).to_pylist()
            counts = [Counter(f["kind"] for f in fs) for fs in lists]
            base = [span_text(fs, KINDS[:3]) for fs in lists]
            yield pa.RecordBatch.from_arrays(
                [ids, *[pa.array([c[k] for c in counts], pa.int64()) for k in KINDS],
                 pa.array([hashlib.sha256(s.encode()).hexdigest() for s in base], pa.string()),
                 pa.array([span_text(fs, KINDS) for fs in lists], pa.string())],
                names=[f.name for f in schema.fields])

    slim = found.select(id_col, F.transform("findings", lambda f: F.struct(
        f["kind"].alias("kind"), f["start"].alias("start"), f["end"].alias("end"))).alias("findings"))
    return slim.mapInArrow(digest, schema)


def redact_text(text: str, spans: list[tuple[int, int, str]]) -> str:
    """Replace the value ranges (start, end, label) by ``[label]``; overlapping ranges become one."""
    merged: list[list] = []
    for s, e, label in sorted(spans):
        if merged and s < merged[-1][1]:
            merged[-1][1] = max(merged[-1][1], e)
        else:
            merged.append([s, e, label])
    out, at = [], 0
    for s, e, label in merged:
        out += [text[at:s], f"[{label}]"]
        at = e
    return "".join([*out, text[at:]])


def redact(docs: DataFrame, text_col: str = "text", repo_col: str = "source", n_chars_col: str | None = "n_chars",
           max_owners: int = 2) -> DataFrame:
    """All documents, with secret values replaced: base matches by ``[SECRET]``
    (``[EXAMPLE]`` if widely copied), and owned values that only the ownership
    counts reveal by ``[SECRET]``.  Documents without findings pass unchanged."""
    scanned = with_spans(docs, text_col)
    clean = scanned.where(F.size("__spans") == 0).drop("__spans")
    dirty = materialize(scanned.where(F.size("__spans") > 0).withColumn("__rid", F.monotonically_increasing_id()),
                        "secret_rows")
    marked = classified(dirty, repo_col, max_owners).where("kind <> 'generic' or status = 'owned'")
    cuts = marked.groupBy("__rid").agg(F.collect_list(F.struct(
        F.col("value_start").alias("s"), (F.col("value_start") + F.char_length("value")).alias("e"),
        F.when(F.col("status") == "copied", F.lit("EXAMPLE")).otherwise(F.lit("SECRET")).alias("label"))).alias("__cuts"))
    joined = dirty.drop("__spans").join(cuts, "__rid", "left").drop("__rid")
    apply = F.udf(lambda t, cs: redact_text(t, [(c["s"], c["e"], c["label"]) for c in cs]) if cs else t, "string")
    fixed = joined.withColumn(text_col, apply(text_col, "__cuts")).drop("__cuts")
    if n_chars_col and n_chars_col in docs.columns:
        fixed = fixed.withColumn(n_chars_col, F.char_length(text_col).cast(docs.schema[n_chars_col].dataType))
    return clean.unionByName(fixed.select(*docs.columns))
