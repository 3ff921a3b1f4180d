"""Sliding windows and deduplication against plain loops, on rows with many equal time stamps."""

import random

import pytest

from tests.flowrows import at, by, flows, row
from tidewatch.operators import alerts as al
from tidewatch.operators import declared, detectors

KEYS = ["hot"] * 6 + ["a", "b", "c"]


def make_rows(seed, count=900):
    rng = random.Random(seed)
    return [
        row(
            rng.randrange(400) + rng.choice([0, 0, 0.25]), src_ip=rng.choice(KEYS), dst_ip=rng.choice(KEYS),
            dst_port=rng.randrange(12), bytes_sent=rng.randrange(60), direction="outbound", action="failed",
            protocol="TCP", flags=rng.choice(["SYN", "SYN", "SYN,ACK"]),
        )
        for _ in range(count)
    ]


def windows(rows, key, width):
    """All windows of each key in order: (key, list of rows up to and including the newest)."""
    order = sorted(range(len(rows)), key=lambda i: (rows[i]["ts"], i))
    groups = {}
    for i in order:
        groups.setdefault(key(rows[i]), []).append(rows[i])
    for k, members in groups.items():
        first = 0
        for last in range(len(members)):
            while (members[last]["ts"] - members[first]["ts"]).total_seconds() > width:
                first += 1
            yield k, members[first:last + 1]


def first_windows(rows, key, width, fires):
    found = {}
    for k, window in windows(rows, key, width):
        if k not in found and fires(window):
            found[k] = window
    return found


def seconds(window):
    return max((window[-1]["ts"] - window[0]["ts"]).total_seconds(), 1)


@pytest.mark.parametrize("seed,chunks", [(1, None), (2, 4), (3, 11)])
def test_windows_match_loops(spark, seed, chunks):
    rows = make_rows(seed)
    fl = flows(spark, rows)

    want = first_windows(rows, lambda r: (r["src_ip"], r["dst_ip"], r["dst_port"]), 9, lambda w: len(w) >= 3)
    got = by(detectors.brute_force(fl, 3, 9, chunks), "src_ip", "dst_ip", "dst_port")
    assert {k: (r["ts"], r["last_ts"], r["attempts"]) for k, r in got.items()} == {
        k: (w[0]["ts"], w[-1]["ts"], 3) for k, w in want.items()}

    want = first_windows(rows, lambda r: r["src_ip"], 7, lambda w: len({r["dst_port"] for r in w}) >= 8)
    got = by(detectors.port_scan(fl, 8, 7, chunks=chunks), "src_ip")
    assert {k: (r["ts"], r["last_ts"], r["event_count"], r["target_count"], r["sample_ports"]) for k, r in got.items()} == {
        k: (w[0]["ts"], w[-1]["ts"], len(w), len({r["dst_ip"] for r in w}), sorted({r["dst_port"] for r in w}))
        for k, w in want.items()}

    want = first_windows(rows, lambda r: r["src_ip"], 20, lambda w: sum(r["bytes_sent"] for r in w if r["bytes_sent"]) >= 1500)
    got = by(detectors.exfiltration(fl, 1500, 20, chunks), "src_ip")
    assert {k: (r["last_ts"], r["total_bytes"]) for k, r in got.items()} == {
        k: (w[-1]["ts"], sum(r["bytes_sent"] for r in w)) for k, w in want.items()}

    rate = lambda w: len(w) / seconds(w) >= 1.3 and len({r["src_ip"] for r in w}) >= 3
    want = first_windows(rows, lambda r: r["dst_ip"], 12, rate)
    got = by(detectors.ddos(fl, 1.3, 3, 12, chunks), "dst_ip")
    assert {k: (r["ts"], r["last_ts"], r["total_events"], r["unique_sources"], r["total_bytes"]) for k, r in got.items()} == {
        k: (w[0]["ts"], w[-1]["ts"], len(w), len({r["src_ip"] for r in w}), sum(r["bytes_sent"] for r in w))
        for k, w in want.items()}

    syn = lambda w: sum(r["flags"] == "SYN" for r in w)
    want = first_windows(rows, lambda r: r["dst_ip"], 6, lambda w: syn(w) >= 4 and syn(w) / max(len(w) - syn(w), 1) >= 4)
    got = by(declared.syn_flood(fl, 4, 4, 6, chunks), "dst_ip")
    assert {k: (r["ts"], r["last_ts"], r["syn_count"]) for k, r in got.items()} == {
        k: (w[0]["ts"], w[-1]["ts"], syn(w)) for k, w in want.items()}


def make_alerts(spark, times):
    """One alert per (key, time)."""
    fl = flows(spark, [row(t, src_ip=key, domain=f"d{i}") for i, (key, t) in enumerate(times)])
    return al.domain_alerts(fl.select("ts", "domain", "src_ip", "dst_ip", "dst_port", "event_id"))


def kept_times(times, width):
    last, kept = {}, []
    for key, t in sorted(times, key=lambda x: x[1]):
        if key not in last or t - last[key] > width:
            last[key] = t
            kept.append((key, at(t)))
    return sorted(kept)


@pytest.mark.parametrize("chunks", [None, 5])
def test_dedup_matches_a_loop(spark, chunks):
    rng = random.Random(7)
    times = [("fold", t) for t in (0, 200, 400, 600)] + [("strict", t) for t in (0, 300, 601)]
    times += [("steady", 50 * i) for i in range(150)]
    times += [(rng.choice(KEYS), rng.randrange(9000)) for _ in range(500)]
    got = sorted((r.src_ip, r.ts) for r in al.dedupe(make_alerts(spark, times), 300, chunks).collect())
    assert got == kept_times(times, 300)
    assert [t for k, t in got if k == "fold"] == [at(0), at(400)]
    assert [t for k, t in got if k == "strict"] == [at(0), at(601)]


@pytest.mark.parametrize("chunks", [None, 6])
def test_beaconing_matches_loops(spark, chunks):
    rng = random.Random(11)
    rows = []
    for i in range(12):
        t = 0.0
        for _ in range(rng.randrange(2, 60)):
            t += rng.choice([5, 5, 5.5, 6, 5 + i])
            rows.append(row(t, src_ip="hot" if i < 4 else f"s{i}", dst_ip=f"d{i % 3}"))
    want = {}
    for r in rows:
        want.setdefault((r["src_ip"], r["dst_ip"]), []).append(r["ts"])
    found = {}
    for pair, times in want.items():
        times.sort()
        gaps = [(b - a).total_seconds() for a, b in zip(times, times[1:])]
        mean = sum(gaps) / len(gaps) if gaps else 0
        std = (sum((g - mean) ** 2 for g in gaps) / len(gaps)) ** 0.5 if gaps else 0
        if len(times) >= 5 and mean > 1 and std / mean * 100 <= 60:
            found[pair] = (len(times), round(mean, 6), round(std, 6))
    got = by(detectors.beaconing(flows(spark, rows), 5, 60, chunks), "src_ip", "dst_ip")
    assert {k: (r["connection_count"], round(r["mean_interval"], 6), round(r["std_interval"], 6)) for k, r in got.items()} == found
