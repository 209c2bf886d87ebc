import hashlib
import io
import math
import random
import wave
from collections import Counter
from zlib import crc32

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from plumbline.llm import audio, language


def test_the_stored_form_is_a_wav_file_of_the_payload():
    payload, n = audio.payload_of("héllo")
    media = audio.to_wav(payload)
    with wave.open(io.BytesIO(media)) as w:
        assert (w.getnchannels(), w.getsampwidth(), w.getframerate()) == (1, 1, audio.RATE) and w.readframes(10_000) == payload
    assert audio.from_wav(media) == (payload, audio.RATE) and n == 6 and len(payload) == 576
    assert audio.from_wav(audio.to_wav(b"odd"))[0] == b"odd"
    with pytest.raises(ValueError):
        audio.from_wav(b"RIFF....nope")


@pytest.mark.parametrize("text, size", [(None, 576), ("", 576), ("x" * 576, 576), ("x" * 577, 1152)])
def test_padding(text, size):
    payload, n = audio.payload_of(text)
    assert len(payload) == size and payload[n:] == b"\xff" * (size - n)


def test_resampling_is_a_polyphase_filter():
    x = np.random.default_rng(0).integers(0, 256, 300).astype(np.uint8)
    h = audio.resampling_filter(audio.UP, audio.DOWN)
    taps = h.T.ravel()
    up = np.zeros(len(x) * audio.UP + 200)
    up[100 : 100 + len(x) * audio.UP : audio.UP] = (x.astype(float) - 128) / 128
    n = len(x) * audio.UP // audio.DOWN
    full = np.convolve(up, taps)
    half = audio.TAPS // 2 * audio.UP
    expected = [full[100 + m * audio.DOWN + half] for m in range(n)]
    assert np.allclose(audio.resampled(x, 0, n), expected, atol=1e-4)
    assert np.allclose(audio.resampled(x, 50, 20), audio.resampled(x, 0, n)[50:70], atol=1e-6)


def test_a_tone_shows_in_its_band():
    rate = audio.RATE
    tone = (128 + 100 * np.sin(2 * np.pi * 1000 * np.arange(rate) / rate)).astype(np.uint8)
    mel, _ = audio.clip_features(audio.to_wav(tone.tobytes()))
    edges = 700 * (10 ** (np.linspace(0, 2595 * np.log10(1 + 4000 / 700), audio.MELS + 2) / 2595) - 1)
    best = int(mel[5:-5].mean(axis=0).argmax())
    assert edges[best] < 1000 < edges[best + 2]


def test_blocks_change_nothing(monkeypatch):
    media = audio.to_wav(np.random.default_rng(1).integers(0, 256, 20_000).astype(np.uint8).tobytes())
    whole = audio.clip_features(media)[0]
    monkeypatch.setattr(audio, "BLOCK_FRAMES", 7)
    assert np.allclose(audio.clip_features(media)[0], whole, atol=1e-3)


def plain_mel(payload):
    """Log-mel frames by definition: every resampled sample, Fourier sum and triangle by itself, frame after frame."""
    x = (np.frombuffer(payload, np.uint8).astype(float) - 128) / 128
    h = audio.resampling_filter(audio.UP, audio.DOWN).astype(float)
    half = audio.TAPS // 2

    def sample(m):
        centre, branch = divmod(m * audio.DOWN, audio.UP)
        return sum(h[branch][audio.TAPS - 1 - k] * x[i] for k in range(audio.TAPS) if 0 <= (i := centre - half + 1 + k) < len(x))

    rate = audio.RATE * audio.UP / audio.DOWN
    count = max(1, 1 + math.ceil((math.ceil(len(x) * audio.UP / audio.DOWN) - audio.FRAME) / audio.HOP))
    y = np.array([sample(m) for m in range((count - 1) * audio.HOP + audio.FRAME)])
    mel = lambda f: 2595 * math.log10(1 + f / 700)
    edges = [700 * (10 ** (mel(rate / 2) * k / (audio.MELS + 1) / 2595) - 1) for k in range(audio.MELS + 2)]
    bins = np.arange(audio.FRAME // 2 + 1)
    waves = np.exp(-2j * np.pi * np.outer(bins, np.arange(audio.FRAME)) / audio.FRAME)
    hann = 0.5 - 0.5 * np.cos(2 * np.pi * np.arange(audio.FRAME) / (audio.FRAME - 1))
    out = np.empty((count, audio.MELS))
    for n in range(count):
        power = np.abs(waves @ (y[n * audio.HOP : n * audio.HOP + audio.FRAME] * hann)) ** 2
        for k in range(audio.MELS):
            low, mid, high = edges[k : k + 3]
            weights = [max(0.0, min((f - low) / (mid - low), (high - f) / (high - mid))) for f in bins * rate / audio.FRAME]
            out[n, k] = 10 * math.log10(power @ weights + 1e-6)
    return out


def plain_segments(energy):
    """Frame by frame: a stretch not under the lower threshold counts if some frame of it reaches the upper one."""
    level, out, begin, loud = float(np.median(energy)), [], None, False
    for n, e in enumerate([*energy, -math.inf]):
        if e - level >= audio.CLOSE_DB:
            begin, loud = n if begin is None else begin, loud or e - level >= audio.OPEN_DB
        else:
            out += [(begin, n)] if begin is not None and loud else []
            begin, loud = None, False
    return out


@pytest.mark.parametrize("text", ["", "short", "Quiet ... LOUD!!! " * 150 + "\n" * 700 + "zzz ÿ漢 " * 60])
def test_frames_and_features_against_a_plain_version(docs, text):
    payload, _ = audio.payload_of(text)
    mel, found = audio.clip_features(audio.to_wav(payload))
    plain = plain_mel(payload)
    assert mel.shape == plain.shape and np.allclose(mel, plain, atol=0.02)
    assert found == plain_segments(mel.mean(axis=1))
    frames, segments, sound, bands, tensors, _ = audio.audio_digests(docs([(1, text, "en", "a")])).first()["feature"].split(":")
    assert (int(frames), int(segments), int(sound)) == (len(plain), len(found), sum(b - a for a, b in found))
    assert int(tensors) == sum(math.ceil((b - a) / audio.TENSOR_FRAMES) for a, b in found)
    assert all(abs(int(x) - 10 * y) <= 1 for x, y in zip(bands.split(","), plain.mean(axis=0)))


def test_a_very_long_clip(docs):
    rows = [(1, "some words and then more " * 60_000, "en", "a"), (None, None, "en", "a"), (2, None, "en", "a"), (2, None, "en", "a")]
    got = audio.audio_digests(docs(rows)).collect()
    assert len(got) == 4 and [r["n_bytes"] for r in got if r["doc_id"] == 1] == [1_500_000] and len({r["feature"] for r in got if r["doc_id"] != 1}) == 1


def test_hysteresis():
    energy = np.array([0, 0, 0.6, 1.6, 1.2, 0.6, 0, 0.6, 0, 0, 0, 0, 0, 2.0])
    assert audio.segments(energy) == [(2, 6), (13, 14)]


def test_tensors_have_a_fixed_shape_and_time_spans(docs):
    text = " ".join(random.Random(2).choice(["lorem", "IPSUM!!", "dolor\n\n", "sit"]) for _ in range(3000))
    row = audio.audio_columns(docs([(1, text, "en", "a")])).first()
    batch = pa.ipc.open_stream(row["tensors"]).read_all()
    assert batch.schema.field("tensor").type == pa.fixed_shape_tensor(pa.float32(), (audio.TENSOR_FRAMES, audio.MELS))
    assert batch.num_rows == len(row["spans"]) > 0 and all(s["begin_s"] < s["end_s"] for s in row["spans"])
    mel, found = audio.clip_features(bytes(row["media"]))
    a = found[0][0]
    n = batch.column("frames")[0].as_py()
    assert np.allclose(batch.column("tensor").combine_chunks().to_numpy_ndarray()[0][:n], mel[a : a + n])


def test_audio_digests(awkward, docs):
    got = audio.audio_digests(awkward).collect()
    texts = {}
    for r in awkward.collect():
        texts.setdefault(r["doc_id"], set()).add(r["text"])
    for r in got:
        assert any(
            r["payload_sha256"] == hashlib.sha256(p).hexdigest() and r["n_bytes"] == n and r["tail_crc32"] == crc32(p[-32:]) and r["media_sha256"] == hashlib.sha256(audio.to_wav(p)).hexdigest() and r["media_bytes"] == 44 + len(p)
            for p, n in map(audio.payload_of, texts[r["doc_id"]])
        )
    by_payload = {}
    for r in got:
        assert by_payload.setdefault(r["payload_sha256"], r["feature"]) == r["feature"]
    assert len(got) == awkward.count() and audio.audio_digests(docs([])).isEmpty()


def test_audio_digests_tell_of_the_stored_tensors(docs):
    rng = random.Random(6)
    frame = docs([(i, " ".join(rng.choice(["lorem", "IPSUM!!", "dolor\n\n", "sit"]) for _ in range(i * 60)), "en", "a") for i in range(12)])
    stored = {r["doc_id"]: bytes(r["tensors"]) for r in audio.audio_columns(frame).collect()}
    for r in audio.audio_digests(frame).collect():
        tensors = pa.ipc.open_stream(stored[r["doc_id"]]).read_all()
        assert r["feature"].split(":")[4:] == [str(tensors.num_rows), f"{crc32(stored[r['doc_id']]):08x}"]
        assert int(r["feature"].split(":")[2]) == sum(tensors.column("frames").to_pylist())


WORDS = {"en": "the of and that with from this have they which".split(), "de": "der die und nicht mit auch für sich schön ein".split(), "fr": "les des une été très avec pour dans être où".split()}


def lang_rows(n=300, seed=4):
    rng = random.Random(seed)
    return [(i, " ".join(rng.choice(WORDS[lang]) for _ in range(rng.randint(5, 60))), lang, "a") for i in range(n) for lang in [rng.choice(list(WORDS))]]


def test_held_out_language(docs):
    rows = lang_rows()
    truth = {i: lang for i, _, lang, _ in rows}
    got = language.identify(docs(rows)).collect()
    held = [r for r in got if r["held_out"]]
    assert {r["doc_id"] for r in held} == {i for i in truth if crc32(str(i).encode()) % 4 == 2}
    assert np.mean([truth[r["doc_id"]] == r["lang_pred"] for r in held]) > 0.97 and all(0 <= r["score"] <= 1 for r in got)


def test_held_out_rows_teach_nothing(docs):
    rows = lang_rows(200)
    swapped = [(i, t, "xx" if crc32(str(i).encode()) % 4 == 2 else lang, s) for i, t, lang, s in rows]
    a, b = (sorted(map(tuple, language.identify(docs(x)).collect())) for x in (rows, swapped))
    assert a == b


def test_out_of_place_distance_by_definition():
    known = language.Profiles({"x": np.array([10, 20, 30]), "y": np.array([30, 40, 10])})
    own = [20, 10, 99]
    for name, d in zip(known.names, known.distances(np.array(own))):
        profile = {"x": [10, 20, 30], "y": [30, 40, 10]}[name]
        expected = [abs(profile.index(g) - r) if g in profile else language.PROFILE for r, g in enumerate(own)]
        assert d == pytest.approx(np.mean(expected) / language.PROFILE)


def test_gram_counts_by_definition():
    letter = language._is_letter()
    grams, counts = language.gram_counts("Ab a-b", letter)
    read = lambda g: "".join(chr(c) for c in (g >> 42 & 0x1FFFFF, g >> 21 & 0x1FFFFF, g & 0x1FFFFF) if c)
    found = {read(int(g)): int(n) for g, n in zip(grams, counts)}
    assert found == {"a": 2, "b": 2, " a": 2, "ab": 1, "b ": 2, "a ": 1, " b": 1, " ab": 1, "ab ": 1, " a ": 1, " b ": 1}


@pytest.mark.parametrize("text", ["some longer text " * 30, "x" * 100, "ab, cd" + "y" * 70 + " z", "", "..", "ΑΣ ΟΔΟΣ. " * 9])
def test_parts_of_long_texts_add_up(monkeypatch, text):
    letter = language._is_letter()
    whole = language.gram_counts(text, letter)
    for part in [*range(1, 40), 64, 99, 100, 101]:
        monkeypatch.setattr(language, "PART", part)
        parts = language.gram_counts(text, letter)
        assert (whole[0] == parts[0]).all() and (whole[1] == parts[1]).all(), part


def plain_grams(text):
    """n-grams of one to three letters with a blank for each side of a word, most frequent first."""
    words = "".join(c if c.isalpha() else " " for c in text.lower()).split()
    found = Counter()
    for w in words:
        padded = f" {w} "
        for n in (1, 2, 3):
            found.update(g for i in range(len(padded) - n + 1) if (g := padded[i : i + n]).strip())
    packed = lambda g: sum(ord(c) << 21 * k for k, c in enumerate(reversed(g)))
    return found, packed


def test_profiles_and_predictions_against_a_plain_version(docs):
    rows = lang_rows(160, seed=8)
    learned = {}
    for i, text, lang, _ in rows:
        if crc32(str(i).encode()) % 4 != 2:
            learned.setdefault(lang, Counter()).update(plain_grams(text)[0])
    packed = plain_grams("")[1]
    ranks = lambda c: [g for g, _ in sorted(c.items(), key=lambda x: (-x[1], packed(x[0])))][: language.PROFILE]
    profiles = {lang: {g: r for r, g in enumerate(ranks(c))} for lang, c in learned.items()}
    for r in language.identify(docs(rows)).collect():
        own = ranks(plain_grams(dict(x[:2] for x in rows)[r["doc_id"]])[0])
        d = {lang: sum(abs(p[g] - k) if g in p else language.PROFILE for k, g in enumerate(own)) / len(own) / language.PROFILE for lang, p in profiles.items()}
        best = min(sorted(d), key=d.get)
        assert abs(r["score"] - (1 - d[best])) < 1e-9 and abs(d[r["lang_pred"]] - d[best]) < 1e-12


def test_rows_are_drawn_by_row_and_bounded(docs, monkeypatch):
    monkeypatch.setattr(language, "LANGUAGE_ROWS", 20)
    two = docs([(i, ("der hund und die katze", "the dog and the cat")[i % 2], ("de", "en")[i % 2], "a") for i in range(400)])
    assert {r["lang"]: r["count"] for r in language.learning_rows(two, "lang", "text", F.lit(True)).groupBy("lang").count().collect()} == {"de": 20, "en": 20}
    assert {(r["doc_id"] % 2, r["lang_pred"]) for r in language.identify(two).collect()} == {(0, "de"), (1, "en")}
    common = docs([(i, "same text" if i % 10 else f"other text {i}", "en", "a") for i in range(1000)] + [(7, "same row", "en", "a")] * 500)
    drawn = [r["text"] for r in language.learning_rows(common, "lang", "text", F.lit(True)).collect()]
    assert len(drawn) == 20 and any(t.startswith("other") for t in drawn)


def test_texts_stay_where_they_lie_and_languages_are_bounded(docs, monkeypatch):
    frame = docs(lang_rows(60))
    plan = language.learning_rows(frame, "lang", "text", F.lit(True))._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan
    monkeypatch.setattr(language, "LANGUAGES", 2)
    with pytest.raises(ValueError):
        language.identify(frame)


def test_many_languages(docs):
    rows = [(i, f"word{chr(97 + i % 26)}{chr(97 + i // 26 % 26)}{chr(97 + i // 676)} " * 3, f"l{i:05}", "a") for i in range(10_000)]
    learned = language.learn_profiles(docs(rows), "lang", "text", F.lit(True))
    assert len(learned) == 10_000
    known = language.Profiles(learned)
    assert all(known.predict(t, language._is_letter())[0] == lang for _, t, lang, _ in rows[::997])


def test_unknown_and_awkward(awkward, docs):
    got = {(r["doc_id"], r["lang_pred"]) for r in language.identify(awkward).collect()}
    assert (2, "und") in got and (3, "und") in got and (4, "und") in got
    assert language.identify(awkward).count() == awkward.count() and language.identify(docs([])).isEmpty()
    unlearned = docs([(1, "text", None, "a")])
    assert language.identify(unlearned).first()["lang_pred"] == "und"
