import json
import random

import pytest

from cladeforge.__main__ import main
from cladeforge.sources import fastx


def test_commands(spark, tmp_path, capsys):
    rng = random.Random(2)
    bases = ["".join(rng.choices("ACGT", k=200)) for _ in range(3)]
    (tmp_path / "ref.fa").write_text("".join(f">r{i};tax=d:D,g:G{i % 3}\n{bases[i % 3]}\n" for i in range(9)))
    (tmp_path / "reads.fq").write_text("".join(f"@read {i}\n{s}\n+\n{'I' * len(s)}\n" for i, s in enumerate([bases[1], bases[2], "ACGT"])))
    main(["index", f"{tmp_path}/ref.fa", "-o", f"{tmp_path}/db"], spark)
    main(["classify", f"{tmp_path}/reads.fq", "--db", f"{tmp_path}/db", "-o", f"{tmp_path}/out"], spark)
    text = "".join(p.read_text() for p in sorted((tmp_path / "out").glob("part-*")))
    assert text.splitlines() == ["read 0\td:D(1.00),g:G1(1.00)\t+\td:D,g:G1", "read 1\td:D(1.00),g:G2(1.00)\t+\td:D,g:G2", "read 2\t\t\t"]
    main(["inspect", f"{tmp_path}/db", "--verify"], spark)
    seen = json.loads(capsys.readouterr().out)
    assert seen["named"]["g"] == 9 and not any(seen["mismatches"].values())
    main(["curate", f"{tmp_path}/ref.fa", "-o", f"{tmp_path}/kept", "--select", "first", "--report", f"{tmp_path}/m.json"], spark)
    kept = "".join(p.read_text() for p in sorted((tmp_path / "kept").glob("part-*")))
    assert [a[:2] for a, _, _ in fastx.records(iter(kept.splitlines(keepends=True)))] == ["r0", "r1", "r2"]
    assert json.loads((tmp_path / "m.json").read_text())["dropped"]["duplicates"] == 6
    with pytest.raises(SystemExit):
        main(["curate", f"{tmp_path}/ref.fa"], spark)


def _text(path):
    return "".join(p.read_text() for p in sorted(path.glob("part-*")))


def test_classify_options(spark, tmp_path, capsys):
    """Scorer, hold-out, features, informative votes, several inputs and refused combinations."""
    rng = random.Random(4)
    bases = ["".join(rng.choices("ACGT", k=220)) for _ in range(4)]
    tax = lambda g: f"tax=d:D,o:O{g % 2},f:F{g},g:G{g}"
    (tmp_path / "a.fa").write_text("".join(f">r{i};{tax(i % 4)}\n{bases[i % 4]}\n" for i in range(5)))
    (tmp_path / "b.fa").write_text("".join(f">r{i};{tax(i % 4)}\n{bases[i % 4][:200]}{bases[(i + 1) % 4][:20]}\n" for i in range(5, 12)))
    (tmp_path / "q.fa").write_text(f">q0;{tax(1)}\n{bases[1]}\n>q1;{tax(2)}\n{bases[2][::-1]}\n")
    (tmp_path / "model").write_text("".join(f"{r} 0.2 6 3 2.5 0.1 -1.5 -2\n" for r in "dkpcofg"))
    main(["index", f"{tmp_path}/a.fa,{tmp_path}/b.fa", "-o", f"{tmp_path}/db"], spark)
    refs = spark.read.parquet(f"{tmp_path}/db/refs")
    assert sorted(r.ref_id for r in refs.collect()) == list(range(12))
    run = lambda out, *more: main(["classify", f"{tmp_path}/q.fa", "--db", f"{tmp_path}/db", "-o", f"{tmp_path}/{out}", *more], spark)
    run("vote", "--emit-informative", "--hash", "sha256", "--profile")
    line = _text(tmp_path / "vote").splitlines()[0].split("\t")
    assert line[0] == f"q0;{tax(1)}" and line[1].startswith("d:D(1.00),o:O1(1.00)") and line[4] == "d:100,k:0,p:0,c:0,o:100,f:100,g:100"
    err = capsys.readouterr().err
    assert "reads=2" in err and '"classified": 1' in err
    run("model_out", "--scorer", "protax", "--protax-params", f"{tmp_path}/model")
    line = _text(tmp_path / "model_out").splitlines()[0].split("\t")
    assert len(line) == 5 and line[4].startswith("d:0.") and "g:G1(" in line[1]
    run("hidden", "--holdout", "g", "--cutoff", "0")
    assert "g:G1" not in _text(tmp_path / "hidden").splitlines()[0].split("\t", 1)[1]
    run("features", "--holdout", "self", "--emit-features")
    rows = [x.split("\t") for x in _text(tmp_path / "features").splitlines()]
    assert rows[0] == "query rank kind node s1 gap vote genera sentinel multiplicity truth".split()
    assert ["d", "present"] in [r[1:3] for r in rows] and any(r[1] == "g" and r[10] == "1" for r in rows[1:])
    for bad in (["--holdout", "self", "--exact"], ["--emit-features"], ["--scorer", "protax", "--support", "adjusted"], ["--risk", "0.1", "--weights", "df"]):
        with pytest.raises(ValueError):
            run("bad", *bad)
    with pytest.raises(SystemExit):
        run("bad", "--scorer", "protax")
    with pytest.raises(SystemExit):
        main(["index", f"{tmp_path}/a.fa", "-o", f"{tmp_path}/a.fa"], spark)


def test_curate_options(spark, tmp_path, capsys):
    rng = random.Random(9)
    seqs = ["".join(rng.choices("ACGT", k=n)) for n in (300, 300, 2600, 400)]
    names = ["tax=d:D,o:O,f:F,g:G", "tax=d:D,o:O,f:F,g:G", "tax=d:_plastid", "tax=d:D,o:O"]
    (tmp_path / "ref.fa").write_text("".join(f">r{i};{n}\n{s}\n" for i, (n, s) in enumerate(zip(names, seqs, strict=True))))
    cache = ["--survey-cache", f"{tmp_path}/cache"]
    main(["curate", f"{tmp_path}/ref.fa", "--plan", "--oversize-list", f"{tmp_path}/long", *cache], spark)
    seen = capsys.readouterr().out
    assert "records 4" in seen and "cap" in seen
    assert _text(tmp_path / "long").split("\t") == ["r2;tax=d:_plastid", "2600\n"]
    main(["curate", f"{tmp_path}/ref.fa", "-o", f"{tmp_path}/kept", "--select", "cover", "--cap", "1", "--shallow-cap", "1,1,1", "--drop-organellar", *cache], spark)
    got = json.loads((tmp_path / "kept.curation.json").read_text())
    assert got["written"]["records"] == 2 and got["dropped"]["deliberate"] == 1 and got["policy"]["shallow_unplaced"] == 1
    (tmp_path / "ref.fa").write_text(">x;tax=d:D\nACGT\n")
    for bad in (["curate", f"{tmp_path}/ref.fa", "--plan", *cache], ["curate", "-", "--plan"], ["curate", f"{tmp_path}/ref.fa", "-o", f"{tmp_path}/ref.fa"], ["curate", f"{tmp_path}/ref.fa", "--plan", "--shallow-cap", "1,2"]):
        with pytest.raises(SystemExit):
            main(bad, spark)
