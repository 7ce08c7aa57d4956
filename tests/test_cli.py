"""The command line: what a command makes is there for the next one."""

import json

import pytest

from quillon.cli import main


def test_commands_share_the_store(spark, tmp_path, capsys):
    (tmp_path / "proj" / "src").mkdir(parents=True)
    (tmp_path / "events").mkdir()
    (tmp_path / "proj" / "src" / "cart.ts").write_text("export function loadCart(id) {\n  return fetchCart(id);\n}\n")
    (tmp_path / "proj" / "README.md").write_text("# Notes\nsee src/cart.ts for the cart\n")
    (tmp_path / "events" / "1.json").write_text('{"path":"src/new.ts","kind":"add","ts":"2025-01-01T00:00:00Z","text":"export const x = () => 1;"}\n')

    def run(*args, store="store"):
        capsys.readouterr()
        assert main(["--store", str(tmp_path / store), *args]) == 0
        return capsys.readouterr().out

    assert json.loads(run("ingest", str(tmp_path / "proj"), "--allow", str(tmp_path)))["chunks"] == 2
    assert json.loads(run("graph"))["type"] == "references"
    run("watch", str(tmp_path / "events"), "--checkpoint", str(tmp_path / "mark"), "--once")
    health = json.loads(run("health"))
    assert health["chunks"] == health["chunk_embeddings"] == health["text_lengths"] == 3 and health["dependencies"] == 1 and health["code_symbols"] == 2
    assert "function loadCart" in run("retrieve", "where is loadCart", "--max-tokens", "500")
    run("export", str(tmp_path / "out"))
    run("import", str(tmp_path / "out"), store="other")
    assert json.loads(run("health", store="other")) == health
    with pytest.raises(ValueError):
        main(["--store", str(tmp_path / "store"), "ingest", "/etc"])
