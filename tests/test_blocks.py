"""Segments and turns in blocks of any length against those of whole transcripts."""

import random

import pytest

from colloquy.operators import blocks, classify, segments, turns

WORDS = "transcript_id int, word_idx long, text string, start_s double, end_s double, speaker string"


@pytest.fixture(scope="module")
def words(spark):
    """Jumping and equal times, missing speakers, a monologue, interjections only, one word, and long pauses."""
    rng = random.Random(12)
    said = ["yeah", "what", "data", "wow", "so", "then", "we", "went"]
    rows = []
    for t in range(6):
        at, who = 0.0, "A"
        for i in range({3: 1, 4: 40}.get(t, 500)):
            at += rng.choice([0.3, 0.3, 0.3, 0.0, -0.4, 5.0]) if t != 4 else 0.4
            who = {1: "A", 4: "AB"[i % 2]}.get(t) or (rng.choice(["A", "B", "C", None, ""]) if rng.random() < 0.35 else who)
            rows.append((t, i, rng.choice(said), round(max(at, 0.0), 2), round(max(at, 0.0) + rng.choice([0.1, 0.5, 2.5]), 2), who))
    return spark.createDataFrame(rows, WORDS).repartition(5).cache()


def _rows(df):
    return sorted(map(str, df.select(*sorted(df.columns)).collect()))


@pytest.mark.parametrize("seconds", [0.5, 7.0, 1e9])
def test_segments_in_blocks(words, seconds):
    assert _rows(blocks.speaker_segments(words, seconds)) == _rows(segments.speaker_segments(words))


@pytest.mark.parametrize("size", [1, 3, 50, 100_000])
def test_turns_in_blocks(words, size):
    plain = turns.assign_turns(classify.classify_segments(segments.with_gaps(segments.speaker_segments(words))))
    found = blocks.assigned_segments(words, seconds=30.0, size=size)
    assert _rows(found.select(*plain.columns)) == _rows(plain)


def test_refined_turns_in_blocks(words):
    plain = turns.assign_turns(classify.classify_segments(segments.with_gaps(segments.speaker_segments(words, keep_words=True))))
    found = blocks.assigned_segments(words, seconds=11.0, size=5, keep_words=True)
    assert _rows(turns.refine_turns(found).drop("interjections")) == _rows(turns.refine_turns(plain).drop("interjections"))


def test_no_words_in_blocks(words):
    assert turns.build_turns(blocks.assigned_segments(words.where("word_idx < 0"))).count() == 0
