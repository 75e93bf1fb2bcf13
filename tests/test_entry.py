import __spark_entry__ as entry


def test_every_sql_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert {"prepare_dataset", "drop_report", "p3_found"} <= set(entry.queries())


def test_core_does_not_import_the_text_part():
    import pathlib

    root = pathlib.Path(entry.__file__).parent / "lumenloom"
    for path in root.rglob("*.py"):
        if "llm" not in path.relative_to(root).parts:
            assert "lumenloom.llm" not in path.read_text()
