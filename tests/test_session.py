from corpusflow import session


def test_shared_folder_is_the_one_of_the_session(spark, tmp_path):
    assert session.shared_dir(spark) == spark.conf.get("spark.checkpoint.dir")
    df = session.materialize(spark.range(3), "t")
    assert df.count() == 3 and all(session.shared_dir(spark) in f for f in df.inputFiles())
