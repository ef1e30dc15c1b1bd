"""Scratch folders where executors run on other machines."""

import os

import pytest

from featloom import session


@pytest.fixture
def remote(spark, monkeypatch):
    monkeypatch.setattr(spark.sparkContext, "master", "spark://host:7077")
    monkeypatch.setattr(session, "_TRIED", set(), raising=False)


def test_a_folder_that_all_machines_see_is_used(spark, remote):
    assert session.written(spark.range(5), "remote").count() == 5


def test_a_folder_is_tried_once(spark, remote, monkeypatch):
    tried = []
    monkeypatch.setattr(session, "_shared", lambda s, folder: not tried.append(folder))
    session.scratch_dir(spark, "a")
    session.scratch_dir(spark, "b")
    assert tried == [spark.conf.get("spark.checkpoint.dir")]


def test_a_folder_where_files_of_tasks_are_missing_is_refused(spark, remote, monkeypatch):
    frame = type(spark.range(1))
    files = frame.inputFiles
    monkeypatch.setattr(frame, "inputFiles", lambda self: files(self)[1:])
    with pytest.raises(ValueError, match="share"):
        session.scratch_dir(spark, "lost")
    assert not [f for f in os.listdir(spark.conf.get("spark.checkpoint.dir")) if "tried" in f]


def test_columns_without_a_type_are_kept(spark):
    df = spark.sql("SELECT null AS n, 1 AS `a.b`")
    back = session.written(df, "void")
    assert back.dtypes == df.dtypes and back.collect() == df.collect()
