from lexiloom.streaming import games


def run(spark, df, name, mode):
    q = df.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
    q.awaitTermination(120)
    return spark.table(name).collect()


def test_new_pages_once(spark, tmp_path):
    rows = [("Paris", "x" * 300, ""), ("paris", "y" * 300, ""), ("Rome", "short", "")]
    spark.createDataFrame(rows, "title string, intro string, url string").write.json(str(tmp_path / "in"))
    stream = spark.readStream.schema("title string, intro string, url string").json(str(tmp_path / "in"))
    assert len(run(spark, games.new_page_stream(stream), "new_pages", "append")) == 1


def test_live_games(spark, tmp_path):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    schema = "game_id long, title string, turn int, guess string"
    rows = [(1, "Grand Paris", 1, "ville"), (1, "Grand Paris", 2, "grand"), (1, "Grand Paris", 3, "paris"), (2, "Rome", 1, "sport")]
    spark.createDataFrame(rows, schema).write.json(str(tmp_path / "in"))
    stream = spark.readStream.schema(schema).json(str(tmp_path / "in"))
    got = run(spark, games.live_games(stream), "live_games", "append")
    assert [(r.game_id, r.solved, r.steps, r.guesses) for r in got] == [(1, True, 3, "ville grand paris")]
