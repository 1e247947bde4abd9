"""Files get their names in tasks, once, whatever is run again; the workspace holds all that is written."""

from pathlib import Path

import pytest

from poolsight.llm.storage import fresh_path, materialise, move_staged
from poolsight.sources import workspace


def test_moves_are_repeatable_and_a_lost_file_is_an_error(spark, tmp_path):
    (tmp_path / "staging").mkdir()
    names = [(f"s{i}", f"final-{i}") for i in range(50)]
    for staged, name in names:
        (tmp_path / "staging" / staged).write_text(name)
    files = spark.createDataFrame(names, "staged string, name string")
    assert move_staged(files.limit(20), str(tmp_path), "staging") == 20
    assert move_staged(files, str(tmp_path), "staging") == 50
    assert all((tmp_path / name).read_text() == name for _, name in names) and not list((tmp_path / "staging").iterdir())
    assert move_staged(files.limit(0), str(tmp_path), "staging") == 0
    with pytest.raises(Exception, match="s-lost"):
        move_staged(spark.createDataFrame([("s-lost", "nowhere")], "staged string, name string"), str(tmp_path), "staging")


def test_tables_lie_in_the_workspace(spark):
    mine = workspace.session_path(spark)
    assert fresh_path(spark, "x").startswith(mine + "/")
    table = materialise(spark.range(3).toDF("n"), "numbers")
    assert Path(table.inputFiles()[0].removeprefix("file:").replace("///", "/")).exists() and mine in table.inputFiles()[0]
