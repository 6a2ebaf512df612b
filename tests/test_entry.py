import subprocess
import sys
from pathlib import Path

ROOT = Path(__file__).resolve().parents[1]


def run(code):
    return subprocess.run([sys.executable, "-c", code], cwd=ROOT, capture_output=True, text=True, timeout=120)


def test_imports_without_a_session():
    out = run("import __spark_entry__ as e; assert set(e.oracle_sql()) <= set(e.queries()); print(len(e.queries()))")
    assert out.returncode == 0 and int(out.stdout) > 60, out.stderr


def test_imports_without_the_training_data_operators():
    code = "import sys; sys.modules['weftgraph.llm'] = None; import __spark_entry__ as e; assert 'martin_metrics' in e.queries() and 'op1_secret_scan' not in e.queries()"
    out = run(code)
    assert out.returncode == 0, out.stderr


def test_imports_without_a_package_that_only_they_need():
    code = "import sys; sys.modules['regex'] = None; import __spark_entry__ as e; assert 'martin_metrics' in e.queries() and 'op8_bpe' not in e.queries()"
    out = run(code)
    assert out.returncode == 0, out.stderr


def test_nothing_else_imports_them():
    for p in (ROOT / "weftgraph").rglob("*.py"):
        if "llm" not in p.parts:
            assert "weftgraph.llm" not in p.read_text(), p


def test_entry(spark):
    import __spark_entry__

    rows = __spark_entry__.entry(spark).collect()
    assert rows and {"unit", "ca", "ce", "distance"} <= set(rows[0].asDict())
