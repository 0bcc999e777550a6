import numpy as np

from chronoset.functions.register import register
from chronoset.operators import signal as G


def test_spectra():
    rate = 8000
    t = np.arange(rate) / rate
    x = np.sin(2 * np.pi * 440 * t)
    p = G.spectrogram(x)
    assert G.band_power(p, rate, (0, 300, 600, 4000)).argmax(axis=1).tolist() == [1] * len(p)
    assert G.chroma_power(p, rate).argmax(axis=1).tolist() == [9] * len(p)
    e = G.harmonic_energy(p, rate, np.full(len(p), 69.0))
    assert (e > G.harmonic_energy(p, rate, np.full(len(p), 75.0))).all()
    assert G.cepstra(G.band_power(p, rate, (0, 300, 600, 4000)), 2).shape == (len(p), 2)
    assert len(G.spectrogram(x[:10])) == 0
    burst = np.concatenate([np.zeros(3000), x[:2000], np.zeros(3000)])
    assert G.flux_onsets(G.spectrogram(burst), 4)[0] in (4, 5)


def test_decode_and_doubles():
    frames, onsets = np.zeros((20, 4)), np.zeros((20, 4))
    frames[3:9, 1] = frames[9:15, 1] = frames[5:7, 2] = 0.9
    onsets[3, 1] = onsets[9, 1] = onsets[5, 2] = 0.8
    assert [n[:3] for n in G.decode_posteriors(frames, onsets)] == [(3, 9, 1), (9, 15, 1)]
    beats = np.array([0.0, 1.0, 1.4, 2.0, 3.0, 3.4, 4.0, 5.0])
    assert G.drop_doubled(beats, np.ones(7)) == [0.0, 1.0, 2.0, 3.0, 4.0, 5.0]
    assert G.drop_doubled(np.array([0.0, 1.0, 2.0, 3.0]), np.ones(3)) == [0.0, 1.0, 2.0, 3.0]
    assert G.drop_doubled(np.array([0.0, 1.0, 1.65, 2.3, 3.3]), np.ones(4)) == [0.0, 1.0, 2.3, 3.3]  # a short pair between ordinary ones


def test_separated_peaks():
    r = np.random.default_rng(2)
    assert G.separated_peaks(np.array([9, 0, 5, 0, 4, 0, 0, 6, 0, 9.0]), 3, 2, 1.0) == [2, 7]
    for _ in range(50):
        x, sep = r.integers(0, 9, r.integers(0, 30)).astype(float), int(r.integers(1, 5))
        want = []
        for i in range(1, len(x) - 1):
            near = x[max(0, i - 3) : i + 4]
            if x[i - 1] <= x[i] > x[i + 1] and x[i] - near.mean() >= 1.0 - 1e-12 and all(i - j >= sep for j in want):
                want.append(i)
        assert G.separated_peaks(x, sep, 3, 1.0) == want


def test_sql_forms(spark):
    register(spark)
    got = spark.sql("select * from align_tokens(array(1, 2), array(1, 3, 2))").collect()
    assert [tuple(r) for r in got] == [(0, 0), (None, 1), (1, 2)]
    got = spark.sql("select * from cluster_onsets(array(0.0d, 4.0d, 6.0d), 5.0d)").collect()
    assert [tuple(r) for r in got] == [(0.0, 0.0), (4.0, 0.0), (6.0, 6.0)]
    assert [tuple(r) for r in spark.sql("select * from segment_changepoints(array(0d,0d,0d,9d,9d,9d), 1.0d, 2)").collect()] == [(3,)]
    assert [tuple(r) for r in spark.sql("select as_of_beat(2.5d, array(0d, 1d, 2d, 4d)), as_of_beat(-1d, array(0d, 1d))").collect()] == [(2, None)]
    row = spark.sql("select theil_sen_slope(id, 2.0 * id + 1) s, circular_mean_of(id + 0.25) c, dominant_phase_of(0.6 + id * 0.001) p from range(20)").first()
    assert abs(row.s - 2) < 1e-9 and abs(row.c - 0.25) < 1e-9 and abs(row.p - 0.6095) < 1e-3
