"""The tools on a small repository, and the protocol."""

import subprocess

from quarry.plans.tools import Project, Server, schemas


def test_tools(spark, tmp_path):
    root = tmp_path / "p"
    root.mkdir()
    git = lambda *a: subprocess.run(["git", "-C", str(root), "-c", "user.name=me", "-c", "user.email=me@x", *a], check=True, capture_output=True)
    git("init", "-q", "-b", "main")
    for i, body in enumerate(["def run():\n    return helper()\ndef helper():\n    return 1", "def run():\n    return helper() + helper()\ndef helper():\n    return 1\ndef idle():\n    pass"]):
        (root / "core.py").write_text(body)
        (root / "main.py").write_text("import core\n")
        git("add", ".")
        git("commit", "-q", "-m", f"change {i}")
    server = Server(Project(spark, str(root), str(tmp_path / "store")))

    def ask(tool, **args):
        got = server.answer({"id": 1, "method": "tools/call", "params": {"name": tool, "arguments": args}})["result"]
        assert "isError" not in got, got
        return got["content"][0]["text"]

    assert "Files: 2 | Symbols: 3" in ask("code_summary")
    assert "core.py:1  [function] run" in ask("code_search", query="RUN")
    assert ask("code_deps", path="main.py") == "main.py\n  core.py" and ask("code_dependents", path="core.py") == "main.py"
    assert "symbols +1 -0" in ask("code_diff", base="HEAD~1")
    assert "change 1" in ask("code_log_recent") and "change 1" in ask("code_log_trace", symbol="idle") and "found in message" in ask("code_log_search", query="change")
    assert "Impact score 2: 1 files, 1 dependents" in ask("code_log_impact", commit="HEAD") and "core.py" in ask("code_hotspots")
    assert "helper" in ask("code_graph_trace", name="run", depth=1) and "idle" in ask("code_graph_dead_code")
    assert "CALLS" in ask("code_graph_stats") and "Communities" in ask("code_graph_architecture") and "Indexed" in ask("code_index_build")
    assert len(schemas()) == 15 and server.answer({"id": 2, "method": "nope"})["error"]["code"] == -32601
    assert server.answer({"method": "notifications/initialized"}) is None and server.answer({"id": 3, "method": "ping"})["result"] == {}
    assert server.answer({"id": 4, "method": "tools/call", "params": {"name": "x"}})["result"]["isError"]
