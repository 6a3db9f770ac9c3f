import importlib
import sys


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() == 12
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_entry_without_the_corpus_operators(monkeypatch):
    import __spark_entry__

    for name in [n for n in sys.modules if n.startswith("tempora.llm") or n == "corpus_pipeline"]:
        monkeypatch.delitem(sys.modules, name)
    monkeypatch.setitem(sys.modules, "corpus_pipeline", None)
    monkeypatch.setitem(sys.modules, "tempora.llm", None)
    module = importlib.reload(__spark_entry__)
    assert module.llm is None and "signflip_test" in module.queries()
    monkeypatch.undo()
    importlib.reload(__spark_entry__)
