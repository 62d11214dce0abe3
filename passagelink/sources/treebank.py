"""Scans of annotated XML: treebanks of nested nodes, and OSIS books with ketiv and qere.

A file is the unit of parallel work (a chapter or a book). Each is read by ``binaryFile`` and walked in an Arrow batch;
records and issues come out as one tagged table, from which ``records()`` and ``issues()`` select.
"""

from __future__ import annotations

import json
import xml.etree.ElementTree as ET
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from passagelink.functions.text import hebrew_forms, squeeze

XML_ID = "{http://www.w3.org/XML/1998/namespace}id"
#: Categories that name a syntactic role, not a phrase, in either corpus (fixed values).
ROLES = {
    "hebrew": frozenset(["S", "V", "O", "O2", "IO", "P", "ADV", "VC", "PP"]),
    "greek": frozenset(["S", "V", "O", "O2", "IO", "P", "ADV", "VC"]),
}
TOKEN_SCHEMA = (
    "tag string, source_file string, sentence_id string, source_record_id string, word_ref string, book string, chapter int, verse int, word int, sub int, surface string, lang string, attributes string, "
    "clause_id string, phrase_id string, role string, alternate_trees int, seq int, code string, message string"
)
LOCUS_SCHEMA = (
    "tag string, source_file string, book string, chapter int, verse int, ordinal int, kind string, ketiv array<struct<slot:int,id:string,text:string,lemma:string,morph:string>>, "
    "qere array<struct<slot:int,id:string,text:string,lemma:string,morph:string>>, slots int, note string, code string, message string"
)


def _name(e: ET.Element) -> str:
    return e.tag.rpartition("}")[2]


def _context(path: list[dict], source_file: str, roles: frozenset[str]) -> tuple[str | None, str | None, str | None]:
    """Nearest clause, nearest phrase and nearest role above a token."""
    clause = phrase = role = None
    for a in reversed(path):
        cat, node = a.get("Cat", ""), (a.get("nodeId") or a.get("morphId") or "").strip()
        if cat == "CL":
            clause = clause or (f"{source_file}#{node}" if node else None)
        elif node and cat not in roles:
            phrase = phrase or f"{source_file}#{node}"
        if cat in roles:
            role = role or cat
    return clause, phrase, role


def _leaves(tree: ET.Element, is_token) -> Iterator[tuple[ET.Element, list[dict]]]:
    """Tokens of a tree in document order with the attributes of the nodes above them; by an explicit stack, as trees are deep."""
    stack = [(tree, [])]
    while stack:
        e, path = stack.pop()
        if is_token(e):
            yield e, path
            continue
        if _name(e) in ("Node", "c"):
            path = [*path, dict(e.attrib)]
        stack.extend((c, path) for c in reversed(list(e)))


def _where(ref: str) -> tuple[str, int, int, int] | None:
    """``BOOK c:v!w`` in parts."""
    book, _, rest = ref.strip().partition(" ")
    cv, _, word = rest.partition("!")
    c, _, v = cv.partition(":")
    return (book, int(c), int(v), int(word)) if book and c.isdigit() and v.isdigit() and word.isdigit() else None


def _scan(content: bytes, source_file: str, flavour: str) -> list[dict]:
    rows: list[dict] = []
    issue = lambda code, message, **x: rows.append({"tag": "issue", "source_file": source_file, "code": code, "message": message, **x})
    try:
        root = ET.fromstring(content)
    except ET.ParseError as x:
        issue("unparsable", str(x))
        return rows
    hebrew = flavour == "hebrew"
    is_token = (lambda e: _name(e) == "m") if hebrew else (lambda e: _name(e) == "Node" and len(e) == 0)
    seq = 0
    for n, s in enumerate((e for e in root.iter() if _name(e) == "Sentence"), 1):
        trees = [e for e in s.iter() if _name(e) == "Tree"]
        label = (s.get("verse") or s.get("ref") or s.get("id") or "").strip()
        sid = f"{source_file}#sentence-{n:04d}" + (f":{label}" if label else "")
        if not trees:
            issue("sentence-without-tree", sid)
            continue
        if len(trees) > 1:
            issue("alternate-syntax-trees", f"first of {len(trees)} analyses taken", sentence_id=sid)
        before, sub = None, 0
        for e, path in _leaves(trees[0], is_token):
            rid = (e.get(XML_ID) or "").strip() or None
            if rid is None and hebrew and (e.get("n") or "").strip():
                rid = e.get("n").strip()
                issue("source-id-fallback", "no xml:id, n taken", source_record_id=rid)
            ref = (e.get("word") if hebrew else e.get("ref")) or ""
            at = _where(ref)
            if rid is None or at is None:
                issue("malformed-token", f"id {rid!r}, reference {ref!r}", source_record_id=rid)
                continue
            text = e.text or ""
            if not text.strip():
                issue("zero-width-morpheme", "empty surface text", source_record_id=rid)
            sub = sub + 1 if ref == before else 1
            before = ref
            seq += 1
            clause, phrase, role = _context(path, source_file, ROLES["hebrew" if hebrew else "greek"])
            near = {k: next((p[k] for p in reversed(path) if p.get(k)), None) for k in ("lemma", "SenseNumber", "Ref")}
            attributes = {k.rpartition("}")[2]: v for k, v in e.attrib.items()} | {k: v for k, v in near.items() if v and k not in e.attrib}
            rows.append({
                "tag": "token", "source_file": source_file, "sentence_id": sid, "source_record_id": rid, "word_ref": ref.strip(), "book": at[0], "chapter": at[1], "verse": at[2], "word": at[3], "sub": sub,
                "surface": text if hebrew else text.strip(), "lang": e.get("lang") or ("H" if hebrew else "G"), "attributes": json.dumps(attributes, ensure_ascii=False, sort_keys=True, separators=(",", ":")),
                "clause_id": clause, "phrase_id": phrase, "role": role, "alternate_trees": len(trees) - 1, "seq": seq,
            })
    return rows


def _files(spark: SparkSession, root: str, pattern: str) -> DataFrame:
    return spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(root).select("path", "content")


def _per_file(scan, schema: str):
    names = [x.strip().split(" ")[0] for x in schema.split(", ")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for path, content in zip(b["path"], b["content"]):
                rows = scan(bytes(content), path.rpartition("/")[2])
                if rows:
                    yield pd.DataFrame(rows).reindex(columns=names).astype(object).where(lambda d: d.notna(), None)

    return run


def treebank(spark: SparkSession, root: str, flavour: str, pattern: str = "*.xml") -> DataFrame:
    """Tokens (tag ``token``) and issues (tag ``issue``) of all treebank files below a folder.

    flavour ``hebrew``: morphemes ``m`` below nodes; ``greek``: nodes without children are the words. Only the first tree of
    a sentence is taken; further ones are counted. Malformed tokens and files become issues, nothing is dropped silently.
    """
    schema = TOKEN_SCHEMA
    return _files(spark, root, pattern).mapInPandas(_per_file(lambda c, f: _scan(c, f, flavour), schema), schema)


def records(scan: DataFrame, tag: str = "token") -> DataFrame:
    return scan.filter(F.col("tag") == tag).drop("tag", "code", "message")


def issues(scan: DataFrame) -> DataFrame:
    return scan.filter("tag = 'issue'").select("source_file", "code", "message", *[c for c in ("source_record_id", "book", "chapter", "verse") if c in scan.columns])


def _osis(content: bytes, source_file: str) -> list[dict]:
    rows: list[dict] = []
    try:
        root = ET.fromstring(content)
    except ET.ParseError as x:
        return [{"tag": "issue", "source_file": source_file, "code": "unparsable", "message": str(x)}]
    word = lambda e, slot: {"slot": slot, "id": (e.get("id") or "").strip() or None, "text": (e.text or "").replace("/", "").strip(), "lemma": (e.get("lemma") or "").strip() or None, "morph": (e.get("morph") or "").strip() or None}
    for v in (e for e in root.iter() if _name(e) == "verse"):
        parts = (v.get("osisID") or "").split(".")
        if len(parts) != 3 or not parts[1].isdigit() or not parts[2].isdigit():
            rows.append({"tag": "issue", "source_file": source_file, "code": "malformed-verse", "message": v.get("osisID")})
            continue
        at = {"source_file": source_file, "book": parts[0], "chapter": int(parts[1]), "verse": int(parts[2])}
        slot, waiting, loci = 0, [], []
        locus = lambda kind, k, q, note: loci.append({"tag": "locus", **at, "ordinal": len(loci) + 1, "kind": kind, "ketiv": k, "qere": q, "note": note})  # noqa: B023,E731
        for e in v:
            if _name(e) == "w":
                slot += 1
                if e.get("type") == "x-ketiv":
                    waiting.append(word(e, slot))
                elif waiting:
                    # a plain word ends a run of ketiv words that no note follows
                    locus("ketiv_only", waiting, [], "interrupted")
                    waiting = []
            elif _name(e) == "note" and e.get("type") == "variant":
                qere = []
                for r in e:
                    if _name(r) == "rdg":
                        for w in r:
                            if _name(w) == "w":
                                slot += 1
                                qere.append(word(w, slot))
                if not waiting and not qere:
                    rows.append({"tag": "issue", **at, "code": "empty-variant", "message": "neither ketiv nor qere"})
                    continue
                locus("paired" if waiting and qere else "ketiv_only" if waiting else "qere_only", waiting, qere, next(((c.text or "").strip() for c in e if _name(c) == "catchWord"), None))
                waiting = []
        if waiting:
            locus("ketiv_only", waiting, [], "verse end")
        rows += [x | {"slots": slot} for x in loci]
        if not loci:
            rows.append({"tag": "verse", **at, "slots": slot})
    return rows


def ketiv_qere(spark: SparkSession, root: str, pattern: str = "*.xml") -> DataFrame:
    """Variant loci (tag ``locus``) with their word slots, verses without any (tag ``verse``), and issues of OSIS books."""
    return _files(spark, root, pattern).mapInPandas(_per_file(_osis, LOCUS_SCHEMA), LOCUS_SCHEMA)


def consonants(c: Column) -> Column:
    """Hebrew text without points and accents."""
    return F.regexp_replace(c, "[֑-ׇ͏]", "")


def locus_registry(loci: DataFrame, primary: DataFrame) -> DataFrame:
    """Loci joined to the primary edition's tokens of their qere slots, with how well the surfaces agree.

    loci: records of ``ketiv_qere()`` with canonical books; primary(book, chapter, verse, word, sub, surface, token_id).
    Columns out: book, chapter, verse, ordinal, kind, ketiv_surface, qere_surface, primary_surface, primary_ids, match_tier
    (exact, consonantal, conflict, or null without both sides).
    """
    text = lambda c: F.array_join(F.transform(c, lambda w: w["text"]), " ")
    base = loci.select("book", "chapter", "verse", "ordinal", "kind", text("ketiv").alias("ketiv_surface"), text("qere").alias("qere_surface"), F.transform("qere", lambda w: w["slot"]).alias("slots"))
    hits = base.select("book", "chapter", "verse", "ordinal", F.explode("slots").alias("word")).join(primary, ["book", "chapter", "verse", "word"])
    words = hits.groupBy("book", "chapter", "verse", "ordinal").agg(F.array_sort(F.collect_list(F.struct("word", "sub", "surface", "token_id"))).alias("w"))
    joined = F.aggregate("w", F.struct(F.lit("").alias("t"), F.lit(0).alias("last")), lambda a, x: F.struct(F.concat(a["t"], F.when((a["last"] != 0) & (a["last"] != x["word"]), " ").otherwise(""), x["surface"]).alias("t"), x["word"].alias("last")))["t"]
    out = base.join(words, ["book", "chapter", "verse", "ordinal"], "left").withColumn("primary_surface", squeeze(joined)).withColumn("primary_ids", F.transform("w", lambda x: x["token_id"]))
    tier = F.when(F.col("primary_surface").isNull() | (F.col("qere_surface") == ""), None).when(F.col("primary_surface") == F.col("qere_surface"), "exact").when(consonants(F.col("primary_surface")) == consonants(F.col("qere_surface")), "consonantal").otherwise("conflict")
    return out.select("book", "chapter", "verse", "ordinal", "kind", "ketiv_surface", "qere_surface", "primary_surface", "primary_ids", tier.alias("match_tier"))


def supplementary_tokens(loci: DataFrame) -> DataFrame:
    """The ketiv words of all loci as tokens of their own, with normalized forms."""
    w = loci.select("book", "chapter", "verse", "ordinal", F.explode("ketiv").alias("w")).select("book", "chapter", "verse", "ordinal", "w.*")
    return w.withColumn("forms", hebrew_forms(F.col("text"))).select("book", "chapter", "verse", "ordinal", "slot", F.col("id").alias("source_record_id"), F.col("text").alias("surface"), "forms.normalized", "forms.unpointed", "lemma", "morph")
