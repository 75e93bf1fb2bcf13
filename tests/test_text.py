from pyspark.sql import functions as F

from lumenloom.functions import text as T


def _apply(spark, fn, values, kind="string"):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")
    return [r[1] for r in sorted(rows.select("i", fn(F.col("v")).alias("x")).collect())]


def test_clean_caption(spark):
    pairs = [
        ('"""Hello"""', "Hello"),
        ("'''Hello'''", "Hello"),
        ('""" "The Blue Boy" """', '"the blue boy"'),
        ('"""Text with """inner""" quotes"""', "Text with inner quotes"),
        ("", ""),
        ('""""""', ""),
        (None, ""),
        ("The image shows a painting of A Boat", "A boat"),
        ("The image shows A Boat", "A boat"),
        ("the image shows A Boat", "The image shows a boat"),
        ("In the picture, In the image, x", "In the image, x"),
        ("　  élan  ", "Élan"),
        ('"""The image shows a cat"""', "The image shows a cat"),
    ]
    assert _apply(spark, T.clean_caption, [p[0] for p in pairs]) == [p[1] for p in pairs]


def test_token_estimate(spark):
    values = [None, "", "one", "two words", "  two   words ", "École deux", "中文标题", "a b c d", " lead"]
    assert _apply(spark, T.token_estimate, values) == [0, 0, 1, 2, int(len("  two   words ") * 0.6), int(len("École deux") * 0.6), int(4 * 0.6), 5, int(5 * 0.6)]


def test_artist_title(spark):
    assert _apply(spark, T.artist_title, ["claude-monet", "o'keeffe", "2nd-place", "ßen", None, "中a"]) == ["Claude Monet", "O'Keeffe", "2Nd Place", "Ssen", None, "中A"]


def test_numbered_prompts_and_picks(spark):
    lists = [[], ["a"], [" a\nb ", "c", "d"]]
    assert _apply(spark, lambda c: T.numbered_prompts(c, 2), lists, "array<string>") == ["", "1. a", "1. a b\n\n2. c\n\n... (+1 more)"]
    lists = [[], ["a"], ["a", "b"], ["a", ""], ["a", None], None]
    assert _apply(spark, T.second_or_first, lists, "array<string>") == [None, "a", "b", "", None, None]
    assert _apply(spark, lambda c: T.second_or_first(c, skip_empty=True), lists, "array<string>") == [None, "a", "b", "a", "a", None]
