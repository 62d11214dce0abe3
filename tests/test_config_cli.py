import json

import pytest

from passagelink import cli, config
from passagelink.sources import governance


def test_settings(tmp_path):
    assert config.Settings().digest() == config.Settings().digest() != config.Settings(rrf_k=10).digest()
    p = tmp_path / "s.json"
    p.write_text(json.dumps({"rrf_k": 10, "penalties": [0.1, 0.2, 0.3]}))
    assert config.load(str(p)).penalties == (0.1, 0.2, 0.3)
    for bad in ({"no": 1}, {"rrf_k": "x"}):
        p.write_text(json.dumps(bad))
        with pytest.raises(ValueError):
            config.load(str(p))


def test_governance(tmp_path, spark):
    p = tmp_path / "g.json"
    ok = {"source_id": "a", "version": "1", "license": "x", "sha256": "0", "status": "approved"}
    p.write_text(json.dumps([ok, ok | {"source_id": "b", "status": "pending"}]))
    s = governance.load_sources(str(p))
    assert governance.approved(s, "a") and len(s) == 2
    with pytest.raises(PermissionError):
        governance.approved(s, "b")
    for bad in ([ok, ok], [ok | {"status": "odd"}], [{"source_id": "a"}]):
        p.write_text(json.dumps(bad))
        with pytest.raises(ValueError):
            governance.load_sources(str(p))
    r = governance.apply_crosswalk(spark.createDataFrame([("e", "A 1:1"), ("e", "A 1:2")], "edition string, reference string"), spark.createDataFrame([("e", "A 1:2", "A 1:3")], "edition string, reference string, target string"))
    assert sorted((x.target_reference, x.mapping_method) for x in r.collect()) == [("A 1:1", "same_label"), ("A 1:3", "crosswalk")]


def test_cli(spark, data, tmp_path, capsys):
    assert cli.main(["queries"]) == 0 and "tfidf_topk" in capsys.readouterr().out
    assert cli.main(["run", "length_buckets", data, "--out", str(tmp_path / "o")]) == 0
    assert spark.read.parquet(str(tmp_path / "o")).count() > 0
    assert cli.main(["compare", str(tmp_path / "o"), str(tmp_path / "o")]) == 0
    assert cli.main(["sql", data, "SELECT count(*) FROM verse_passages"]) == 0
