import io

from tidelog.__main__ import main


def test_forward_query_and_upkeep(spark, tmp_path, capsys, monkeypatch):
    store = f"file://{tmp_path}/store"
    monkeypatch.setattr("sys.stdin", io.StringIO("one error\ntwo\nthree error\n"))
    assert main(["forward", store, "--prefix", "web", "--prefix", "eu"]) == 0
    assert main(["testsvc", store, "--n", "20", "--size", "80"]) == 0
    capsys.readouterr()
    assert main(["query", store, "--q", "error"]) == 0
    assert capsys.readouterr().out.splitlines() == ["web eu one error", "web eu three error"]
    assert main(["query", store, "--q", "^testsvc .*0000000(0|1)[0-9] ", "--regex", "--ulid", "--to", "now"]) == 0
    assert len(capsys.readouterr().out.splitlines()) == 20
    assert main(["query", store, "--stats"]) == 0
    assert "segments" in capsys.readouterr().out
    assert main(["store", store, "--turns", "2", "--recover"]) == 0
    capsys.readouterr()
    assert main(["query", store]) == 0
    assert len(capsys.readouterr().out.splitlines()) == 23
