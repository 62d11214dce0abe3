"""Source records and the crosswalk between the verse numbers of editions."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

REQUIRED = ("source_id", "version", "license", "sha256", "status")
STATUSES = ("approved", "pending", "rejected")


def load_sources(path: str) -> dict[str, dict]:
    """Governance records of sources from a JSON list, keyed by id; incomplete, repeated and unknown ones fail."""
    with open(path, encoding="utf-8") as f:
        records = json.load(f)
    out: dict[str, dict] = {}
    for r in records:
        if missing := [k for k in REQUIRED if not r.get(k)]:
            raise ValueError(f"source without {missing}: {r}")
        if r["status"] not in STATUSES:
            raise ValueError(f"{r['source_id']}: status {r['status']}")
        if r["source_id"] in out:
            raise ValueError(f"{r['source_id']}: repeated")
        out[r["source_id"]] = r
    return out


def approved(sources: dict[str, dict], source_id: str) -> dict:
    """A source that may be acquired."""
    if (r := sources.get(source_id)) is None or r["status"] != "approved":
        raise PermissionError(f"{source_id} is not approved")
    return r


def apply_crosswalk(refs: DataFrame, crosswalk: DataFrame) -> DataFrame:
    """References of one edition in the numbering of another: refs(edition, reference) with crosswalk(edition, reference,
    target). References the crosswalk doesn't list keep their label and say so. The crosswalk is a table of an edition's
    verses; Spark broadcasts it below its size limit."""
    c = crosswalk.select("edition", "reference", "target").distinct()
    j = refs.join(c, ["edition", "reference"], "left")
    return j.select(*refs.columns, F.coalesce("target", "reference").alias("target_reference"), F.when(F.col("target").isNull(), "same_label").otherwise("crosswalk").alias("mapping_method"))
