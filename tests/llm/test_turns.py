import pytest

from frameloom.llm.turns import segments, speaker_turns

WHO = ((1, "maruna"), (2, "tovik"), (12, "ysselk"), (17, "norbix"))


@pytest.mark.parametrize(
    "label",
    ["Maruna:", "MARUNA：", "maruna :", "**Maruna**:", "[Maruna]", "<maruna>", ">> Maruna:", "Maruna -", "Maruna (Speaker 1):", "Maruuna:", "Maruan:", "Speaker 1:", "SPEAKER_01:", "Spk-1 ::", "spk1:", "S1:", "[08:01:02] Maruna:", "10:27:32,651 --> Maruna:"],
)
def test_labels(label):
    assert segments(f"before that {label} well, it's 9 cups", WHO) == [(None, "before that", 2), ("maruna", "well it's 9 cups", 4)]


@pytest.mark.parametrize("noise", ["um", "Ummm,", "hmm...", "uhhh", "ummmmmmmmmmmm", "Hmmmmmmmmmmmm", "ehmmmmm", "äh", "er", "[LAUGHTER]", "(chair scrapes)", "((inaudible))", "{music}", "<crosstalk>", "*clears throat*", "♪ humming ♪", "10:27:39", "(27:33)", "[05:13.992]", "11:09:58,331 -->", "...", "/"])
def test_what_is_no_speech(noise):
    assert segments(f"the cup {noise} fell", WHO) == [(None, "the cup fell", 3)]
    assert segments(noise, WHO) == [(None, "", 0)]


def test_context_rules():
    # A name without a label's marks, a hesitation inside a word, a long aside, a speaker word.
    assert segments("ask Maruna again", WHO)[0][1] == "ask Maruna again"
    assert segments("umbrella and hmm-shop, erase", WHO)[0][1] == "umbrella and hmm-shop erase"
    assert segments("so (I really think that you should go) now", WHO)[0][2] == 9
    assert segments("which speaker? S1 is out", WHO) == [(None, "which speaker S1 is out", 5)]
    assert segments("Tovik: yes. Ysselk - no Spk-12 :: maybe", WHO) == [(None, "", 0), ("tovik", "yes", 1), ("ysselk", "no", 1), ("ysselk", "maybe", 1)]
    assert segments("so (I really think that you should go) now", WHO, annotation_words=7)[0][1] == "so now"
    assert segments("[unclosed word", WHO)[0][2] == 2
    # Drawn-out letters: a hesitation of any length, words and labels after it in their own places.
    assert segments("Sooooo uhhhhhhhhhhh Tovik: goooood ummmmmmmmq mmmmmmmmmm yes", WHO) == [(None, "Sooooo", 1), ("tovik", "goooood ummmmmmmmq yes", 3)]
    assert segments("Marunnnna: yes", WHO) == [(None, "", 0), ("maruna", "yes", 1)]
    assert segments(None, WHO) == [] and segments("  \n", WHO) == []
    assert segments("İİ Tovik: ok", WHO)[1] == ("tovik", "ok", 1)


def test_long_text_in_one_go():
    got = segments("Tovik: yes um no " * 20_000, WHO)
    assert len(got) == 20_001 and sum(n for _, _, n in got) == 40_000


def test_turns_over_chunks(spark):
    cols = "row_index long, frame_id string, day string, stream_name string, hour string, frame_index int, time_offset_sec int, raw_text string, words string"
    rows = [
        (5, None, "day1", "tovik", "08", None, 0, "nobody yet. Tovik:", "x"), (4, None, "Day01", "TOVIK ", "8", 2, None, "one two", "x"), (4, None, "Day01", "TOVIK ", "8", 2, None, "one two", "x"),
        (6, "tovik__day1__08_0003", "day1", "tovik", " 08", None, None, "[LAUGHTER] um", "x"), (7, None, "day1", "tovik", "08", None, 15, None, "x"), (8, None, "day1", "tovik", "08", None, 15, "Speaker 2: three. S1: four", "x"),
        (9, None, "day1", "tovik", "08", None, 20, "five SPEAKER_02:", "x"), (10, None, "day1", "tovik", "09", None, 0, "six. Norbix: seven", "x"), (11, None, None, None, None, None, 0, "lost", "x"),
    ]
    t = spark.createDataFrame(rows, cols)
    s = spark.createDataFrame([(n, w, None) for n, w in WHO] + [(None, None, None)], "speaker_no int, speaker string, stream_name string")
    got = [(r.hour, r.turn_no, r.first_row, r.last_row, r.speaker, r.words) for r in speaker_turns(t, s).orderBy("hour", "turn_no").collect()]
    assert got == [(8, 1, 4, 8, "tovik", "one two three"), (8, 2, 8, 9, "maruna", "four five"), (9, 1, 10, 10, "norbix", "seven")]
    assert speaker_turns(t.limit(0), s).count() == 0
    assert speaker_turns(t, s.limit(0)).count() == 0
