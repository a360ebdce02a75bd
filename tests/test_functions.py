"""Filters, scalar functions, readers and migration kernels, without the driver's tables."""

import math
import struct

import numpy as np
import pytest

from firnlight.functions import filters as N
from firnlight.operators import analysis, migration, moveout
from firnlight.operators import picks as P
from firnlight.operators.filters import band_pass_operator, corner
from firnlight.sources import binary
from tests.whole_matrix import phase_shift_matrix, stolt_matrix


def gain(sos, w):
    z, h = np.exp(-1j * np.pi * np.asarray(w)), 1
    for s in sos:
        h = h * (s[0] + s[1] * z + s[2] * z * z) / (s[3] + s[4] * z + s[5] * z * z)
    return np.abs(h)


@pytest.mark.parametrize("order", [3, 5])
def test_butterworth_gains(order):
    assert gain(N.sections(order, [0.3], "low"), [1e-9, 0.3]) == pytest.approx([1, math.sqrt(0.5)])
    assert gain(N.sections(order, [0.3], "high"), [1 - 1e-9, 0.3]) == pytest.approx([1, math.sqrt(0.5)])
    assert gain(N.sections(order, [0.2, 0.5]), [0.2, 0.5]) == pytest.approx([math.sqrt(0.5)] * 2)
    assert gain(N.sections(order, [0.2, 0.5], kind="cheby1"), [0.2, 0.5]) == pytest.approx([10 ** (-5 / 20)] * 2)
    assert gain(N.sections(order, [0.2, 0.5], kind="bessel"), [0.33]) == pytest.approx([1], abs=1e-3)


def test_zero_phase_keeps_constants_and_symmetry():
    low = N.sections(3, [0.3], "low")
    assert N.zero_phase(low, np.ones((80, 2)), 12) == pytest.approx(np.ones((80, 2)))
    spike = np.zeros((81, 1))
    spike[40] = 1
    out = N.zero_phase(low, spike, 12)[:, 0]
    assert out == pytest.approx(out[::-1], abs=1e-9)


@pytest.mark.parametrize("kind", ["butter", "cheby1", "bessel"])
def test_band_pass_removes_constants(kind):
    x = np.ones((500, 4))
    assert np.abs(band_pass_operator(1e-9, 0.1, 100.0, 5, kind)(x)).max() < 1e-3
    assert corner(100.0, 1e-9) == pytest.approx(0.2)


def test_operator_matrix():
    f = band_pass_operator(1e-8, 10, 30, 3)
    x = np.random.default_rng(0).normal(size=(64, 3))
    assert N.operator_matrix(f, 64) @ x == pytest.approx(f(x), abs=1e-9)


def test_peaks_and_median():
    x = np.zeros(50)
    x[10], x[30:33] = 3, 5
    assert N.peaks(x, prominence=4).tolist() == [31]
    assert N.median_filter(np.array([1.0, 9, 2, 3]), 3).tolist() == [1, 2, 3, 2]


def test_pick_window_and_packet():
    trace = np.zeros(200)
    trace[95], trace[101], trace[107] = -100, 100, -200
    w = P.PickWindow.of(0.9, 1e-7, 200)
    w.check()
    top, centre, bottom, power = P.pick_one(trace, w, 101)
    assert (top, centre, bottom) == (95, 101, 107)
    assert power == pytest.approx((100**2 + 100**2 + 200**2) / 13)
    assert P.PickWindow.of(1e6, 1e-7, 200).length == 3


def test_t_quantile():
    for p, df, want in ((0.975, 10, 2.228139), (0.975, 5, 2.570582), (0.95, 30, 1.697261)):
        assert analysis.t_quantile(p, df) == pytest.approx(want, abs=1e-5)


def test_migrations_focus_a_point():
    n, m, dt, dx, v = 128, 65, 1e-8, 1.0, 1.68e8
    z0, x0 = 40, 32
    data = np.zeros((n, m))
    for j in range(m):
        t = 2 / v * math.hypot(z0 * dt * v / 2, (j - x0) * dx)
        k = round(t / dt)
        if k < n:
            data[k, j] = 1
    for f in (stolt_matrix, phase_shift_matrix):
        out = f(data, dt, dx, v)
        at = np.unravel_index(np.abs(out).argmax(), out.shape)
        assert abs(at[0] - z0) <= 2 and abs(at[1] - x0) <= 2


def test_velocity_profile():
    assert migration.velocity_profile([(2e8, 0.0), (2e8, 100.0)], [0.0, 0.5, 1.0]) == pytest.approx([2e8] * 3)
    for bad in ([], [(-1.0, 0.0)]):
        with pytest.raises(ValueError):
            migration.velocity_profile(bad, [0.0, 1.0])


def test_depths_of_uniform_ice():
    t = [0.01 * k for k in range(50)]
    assert moveout.depths_of(t, [0.0, 100.0], [917.0, 917.0], lambda r: 4.0) == pytest.approx([x / 2 * 1.5e8 * 1e-6 for x in t])
    assert moveout.rms_depths(t, [0.0, 100.0], [917.0, 917.0], lambda r: 4.0, 1e-8) == pytest.approx([x / 2 * 1.5e8 * 1e-6 for x in t], rel=1e-6)


def test_dzt_reader():
    data = np.arange(24, dtype="<u2").reshape(4, 6)
    head = bytearray(32768 * 2)
    struct.pack_into("<HHh", head, 4, 6, 16, 3)
    struct.pack_into("<f", head, 26, 60.0)
    struct.pack_into("<H", head, 52, 1)
    out = binary.parse_dzt("a/line.DZT", bytes(head) + data.tobytes())
    assert out.snum.tolist() == [6] * 4 and out.dt[0] == pytest.approx(1e-8) and out.trig[0] == 3
    assert out.samples[1].tolist() == [8, 8, 8, 9, 10, 11]


def test_dt1_reader():
    keys = {"NUMBER OF PTS/TRC": "120", "TOTAL TIME WINDOW": "120", "VERSION": "1.0"}
    raw = b""
    for k in range(3):
        raw += np.r_[[k + 1, 5.0 * k], np.zeros(23)].astype("<f4").tobytes() + b"\0" * 28 + (np.ones(120) * k + np.r_[np.zeros(100), np.ones(20)]).astype("<i2").tobytes()
    out = binary.parse_dt1(keys)("x.DT1", raw)
    assert out.trace_num.tolist() == [1, 2, 3] and out.dist.tolist() == [0, 0.005, 0.01]
    assert out.samples[2][:100].tolist() == [0] * 100 and out.samples[2][-1] == 1


def test_segy_round_trip():
    x = np.random.default_rng(0).normal(size=(30, 5)).astype("f4")
    out = binary.parse_segy("x.sgy", binary.write_segy(x, 10))
    assert np.array(out.samples.tolist()).T == pytest.approx(x.astype(float)) and out.dt[0] == pytest.approx(1e-8)


def test_other_readers():
    rd3 = binary.parse_rd3(4, 40.0)("x.rd3", np.arange(8, dtype="<i2").tobytes())
    assert rd3.samples[1].tolist() == [4, 5, 6, 7] and rd3.trig[0] == 36
    rec = b"".join(struct.pack("<fHhffHH", k, k, 0, 0, 0, 0, 4) + np.array([512, 512, 612, 512], "<u2").tobytes() for k in range(2))
    tek = binary.parse_wheel()("x.DAT", rec)
    assert tek.samples[0].tolist() == [0, 0, 100, 0] and tek.dist[1] == pytest.approx(math.pi * 0.5)
    burst = b"N_ADC_SAMPLES=4\r\nNSubBursts=2\r\nAverage=0\r\n*** End Header ***\r\n" + np.full(8, 32768, "<u2").tobytes()
    assert binary.parse_bursts("x.DAT", burst).samples[1].tolist() == [1.25] * 4
    assert binary.split_project(b"..line1.hdAAAline2.dt1BB") == {"line1.hd": b"AAA", "line2.dt1": b"BB"}
    for bad in (b"", b"x" * 100):
        with pytest.raises((ValueError, IndexError, struct.error)):
            binary.parse_dzt("x", bad)


@pytest.mark.parametrize("packed", [False, True])
def test_matlab_round_trip(packed):
    from firnlight.sources import matlab

    x = np.arange(12.0).reshape(3, 4)
    raw = matlab.write_mat({"data": x, "dt": 1e-8, "lat": np.arange(4.0), "fn": "line 1", "flags": {"agc": 1.0, "note": "ok"}}, packed)
    got = matlab.read_mat(raw)
    assert got["data"].tolist() == x.tolist() and got["fn"] == "line 1" and got["flags"]["note"] == "ok" and got["flags"]["agc"][0, 0] == 1
    traces = matlab.parse_native("a/line.mat", raw)
    assert traces.samples[1].tolist() == [1, 5, 9] and traces.lat.tolist() == [0, 1, 2, 3] and traces.dt[0] == 1e-8
    assert matlab.gps_rows(matlab.write_mat({k: np.arange(3.0) for k in ("decday", "long", "lat", "elev")})).shape == (3, 4)
    for bad in (b"", b"\x89HDF" + b"x" * 200, raw[:100]):
        with pytest.raises(ValueError):
            matlab.read_mat(bad)


def test_sounder_and_simulation():
    from firnlight.sources import matlab

    mat = {"Data": np.array([[1.0, 10.0], [100.0, 0.0], [1.0, 1.0]]), "Latitude": [70.0, 71.0], "Longitude": [-40.0, -41.0], "GPS_time": [0.0, 86400.0], "Time": [0.0, 1e-8, 2e-8]}
    out = matlab.parse_sounder("x.mat", matlab.write_mat(mat))
    assert out.samples[0].tolist() == [0, 20, 0] and np.isnan(out.samples[1][1]) and out.decday.tolist() == [719529, 719530] and out.dt[0] == pytest.approx(1e-8)
    sim = binary.parse_simulation(1e-9)("x.txt", b"0 5 1\n0 5 2\n")
    assert sim.samples[1].tolist() == [5, 2] and len(sim) == 2


@pytest.mark.parametrize("version", [300, 320, 321, 360, 380])
def test_recordings_of_all_versions_and_channels(version):
    old = version < 360
    head = bytearray(93 + 2 * (version < 321) + (2 if version < 380 else 4) + 4 + 27 * old)
    struct.pack_into("<H", head, 0, version)
    head[76] = 2
    struct.pack_into("<HHH", head, 82, 250, 1, 2)
    raw = bytes(head) + b"".join(struct.pack("<BHBB", k, 500, 0, 0) + bytes(27 * old) for k in (1, 2))

    def record(kind, day, *values):
        gauges = struct.pack("<ff", 7.0, 8.5) if version < 321 else b""
        place = struct.pack("<BxidfH", kind, 1, day, 2.0, 50) + gauges + struct.pack("<ddff", -80.0, 170.0, 900.0, 0.1)
        return place + bytes(0 if not old else 12 if version < 320 else 14) + (bytes(38) if kind == 1 else struct.pack(f"<{len(values)}h", *values))

    raw += record(0, 1.0, 1, 2, 3) + record(0, 1.0, 4, 5, 6) + record(1, 1.5) + record(0, 2.0, 7, 8, 9) + record(0, 2.0, -1, -2, -3)
    for channel, want in ((1, [[1, 2, 3], [7, 8, 9]]), (2, [[4, 5, 6], [-1, -2, -3]])):
        cut = raw + record(0, 3.0, 1, 1, 1)[:-2]  # the last record breaks off
        with pytest.raises(ValueError, match="breaks off"):
            binary.parse_gecko(channel)("a/x.gtd", cut)
        got = binary.parse_gecko(channel, strict=False)("a/x.gtd", cut)
        assert [x.tolist() for x in got.samples] == want and got.decday.tolist() == [719530.0, 719531.0]
        assert got.dt[0] == pytest.approx(4e-9) and got.trig[0] == 1 and got.elev[0] == 900 and got.pressure[0] == (8.5 if version < 321 else 0)
    with pytest.raises(ValueError):
        binary.parse_gecko(3)("x.gtd", raw)
