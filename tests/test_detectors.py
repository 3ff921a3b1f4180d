"""Boundary fixtures of the detectors, with results worked out by hand."""

import math

import pytest

from tests.flowrows import at, by, flows, row
from tidewatch.operators import declared, detectors, threat


@pytest.mark.parametrize("chunks", [None, 3])
def test_brute_force(spark, chunks):
    def tries(src, times, **more):
        return [row(t, src_ip=src, **{"dst_port": 22, "action": "failed", **more}) for t in times]

    fl = flows(spark, [
        *tries("inclusive", [0, 75, 150, 225, 300]), *tries("late", [0, 75, 150, 225, 301]),
        *tries("ties", [7] * 7), *tries("deny", range(5), action="deny"), *tries("denied", range(5), action="denied"),
        *tries("odd", range(5), dst_port=9999), *tries("odd-drop", range(5), action="drop", dst_port=9999),
        *tries("slides", [0, 200, 400, 500, 600, 650, 690]),
    ])
    got = by(detectors.brute_force(fl, chunks=chunks), "src_ip")
    assert set(got) == {"inclusive", "ties", "denied", "odd", "slides"}
    assert {r["attempts"] for r in got.values()} == {5}
    assert (got["inclusive"]["ts"], got["inclusive"]["last_ts"], got["inclusive"]["span_seconds"]) == (at(0), at(300), 300)
    assert (got["ties"]["ts"], got["ties"]["span_seconds"]) == (at(7), 0)
    assert (got["odd"]["service"], got["denied"]["service"]) == ("Port 9999", "SSH")
    assert (got["slides"]["ts"], got["slides"]["last_ts"]) == (at(400), at(690))


@pytest.mark.parametrize("chunks", [None, 3])
def test_port_scan(spark, chunks):
    def probes(src, times, targets=1):
        return [row(t, src_ip=src, dst_port=i, dst_ip=f"t{i % targets}") for i, t in enumerate(times)]

    fl = flows(spark, [
        *probes("quick", range(15)), *probes("exact", [*range(14), 60]), *probes("late", [*range(14), 61]),
        *probes("few", [0] * 14), *probes("ties", [5] * 20), *probes("wide", range(15), 4),
        *probes("narrow", range(15), 3), *probes("again", [0] * 14 + [30] * 14 + [100] * 20),
    ])
    got = by(detectors.port_scan(fl, chunks=chunks), "src_ip")
    # "again" brings its fifteenth port within the window only at 30.
    assert set(got) == {"quick", "exact", "ties", "wide", "narrow", "again"}
    assert {r["unique_ports"] for r in got.values()} == {15}
    assert (got["ties"]["event_count"], got["ties"]["ts"], got["ties"]["sample_ports"]) == (15, at(5), list(range(15)))
    assert (got["wide"]["scan_type"], got["wide"]["dst_ip"]) == ("horizontal", "4 targets")
    assert (got["narrow"]["scan_type"], got["narrow"]["dst_ip"]) == ("vertical", "3 targets")
    assert (got["quick"]["dst_ip"], got["quick"]["last_ts"]) == ("t0", at(14))
    assert (got["again"]["ts"], got["again"]["last_ts"], got["again"]["event_count"]) == (at(0), at(30), 15)


@pytest.mark.parametrize("chunks", [None, 4])
def test_ddos(spark, chunks):
    def flood(dst, count, sources, seconds=lambda i: 0):
        return [row(seconds(i), dst_ip=dst, src_ip=f"s{i % sources}", bytes_sent=1, bytes_received=2) for i in range(count)]

    fl = flows(spark, [
        *flood("burst", 1000, 50), *flood("few-sources", 1000, 49), *flood("few-rows", 999, 50),
        *flood("spread", 1200, 60, lambda i: i / 150), *flood("late", 1000, 50, lambda i: 20),
        *[row(0, dst_ip="late", src_ip="early")],
    ])
    got = by(detectors.ddos(fl, chunks=chunks), "dst_ip")
    assert set(got) == {"burst", "late"}
    hit = got["burst"]
    assert (hit["total_events"], hit["unique_sources"], hit["duration_seconds"], hit["requests_per_second"]) == (
        1000, 50, 1.0, 1000.0)
    assert (hit["total_bytes"], hit["ts"]) == (3000, at(0))
    assert [(s["ip"], s["events"]) for s in hit["top_sources"]] == [
        (f"s{i}", 20) for i in sorted(range(50), key=str)[:10]]
    assert (got["late"]["ts"], got["late"]["unique_sources"]) == (at(20), 50)


@pytest.mark.parametrize("chunks", [None, 3])
def test_exfiltration(spark, chunks):
    half = 52_428_800
    def sent(src, times, direction="outbound", size=half):
        return [row(t, src_ip=src, bytes_sent=size, direction=direction) for t in times]

    fl = flows(spark, [
        *sent("inclusive", [0, 3600]), *sent("late", [0, 3601]), *sent("unknown", [0, 1], "unknown"),
        *sent("internal", [0, 1], "internal"), *sent("zero", [0], size=0), *sent("zero", [1, 2]),
        *sent("slides", [0, 3000, 3700]),
    ])
    got = by(detectors.exfiltration(fl, chunks=chunks), "src_ip")
    assert set(got) == {"inclusive", "unknown", "zero", "slides"}
    assert (got["inclusive"]["total_bytes"], got["inclusive"]["transfer_count"]) == (104_857_600, 2)
    assert (got["zero"]["ts"], got["zero"]["transfer_count"]) == (at(1), 2)
    assert (got["slides"]["ts"], got["slides"]["last_ts"]) == (at(0), at(3000))


def test_beaconing(spark):
    def beats(src, times):
        return [row(t, src_ip=src) for t in times]

    fl = flows(spark, [
        *beats("regular", range(0, 3000, 300)), *beats("nine", range(0, 2700, 300)), *beats("fast", range(10)),
        *beats("jitter", [0, 290, 600, 905, 1200, 1490, 1800, 2110, 2400, 2700]),
        *beats("wild", [0, 10, 600, 905, 1000, 1490, 1500, 2110, 2120, 2700]), *beats("same", [5] * 12),
    ])
    for chunks in (None, 1, 7):
        got = by(detectors.beaconing(fl, chunks=chunks), "src_ip")
        assert set(got) == {"regular", "jitter"}
        regular = got["regular"]
        assert (regular["connection_count"], regular["mean_interval"], regular["cv_percent"]) == (10, 300.0, 0.0)
        assert (regular["ts"], regular["last_ts"]) == (at(0), at(2700))


def test_after_hours(spark):
    before, after = 4 * 3600 + 3599, 5 * 3600
    fl = flows(spark, [
        *[row(before, src_ip="night", dst_ip=f"t{i % 3}", bytes_sent=2, bytes_received=1) for i in range(20)],
        *[row(after, src_ip="day") for _ in range(20)], *[row(before, src_ip="few") for _ in range(19)],
        *[row(23 * 3600, src_ip="late") for _ in range(20)],
    ])
    got = by(detectors.after_hours(fl), "src_ip")
    assert set(got) == {"night"}
    assert (got["night"]["event_count"], got["night"]["unique_destinations"], got["night"]["total_bytes"]) == (20, 3, 60)
    assert got["night"]["ts"] == at(before)
    assert set(by(detectors.after_hours(fl, 22, 5, wrap=True), "src_ip")) == {"night", "late"}
    assert detectors.after_hours(fl, 22, 5).count() == 0


def test_anomaly(spark):
    def counts(*sizes):
        return flows(spark, [row(i, src_ip=f"s{n}") for n, size in enumerate(sizes) for i in range(size)])

    got = detectors.anomaly(counts(*[1] * 10, 50)).collect()
    assert [(r.src_ip, r.severity, r.ts) for r in got] == [("s10", "MEDIUM", at(0))]
    assert math.isclose(got[0].z_score, math.sqrt(10))
    assert [r.severity for r in detectors.anomaly(counts(*[1] * 17, 50)).collect()] == ["HIGH"]
    assert detectors.anomaly(counts(*[3] * 12)).count() == 0  # no spread
    assert detectors.anomaly(counts(1, 40)).count() == 0  # too few sources
    assert detectors.anomaly(counts(1, 1, 1, 1, 1, 4), "high").count() == 0  # too few events
    assert detectors.anomaly(counts(*[1] * 10, 50), "low").count() == 0
    assert detectors.anomaly(counts(*[1] * 10, 50), "custom", 3.2).count() == 0


def test_threat_feeds(spark, monkeypatch):
    feed = spark.createDataFrame([
        ("malicious_ip", "6.6.6.6"), ("tor_exit_node", "6.6.6.6"), ("malicious_ip", "fe80::a"),
        ("malicious_domain", "evil.com"),
    ], "kind STRING, indicator STRING")
    fl = flows(spark, [
        row(0, dst_ip="6.6.6.6", dst_port=1), row(5, src_ip="6.6.6.6"), row(3, src_ip="FE80::A", dst_ip="fe80::a"),
        row(1, domain="EVIL.com"), row(2, domain="a.evil.com"), row(2, domain="evil.com"), row(9),
    ])
    for limit in (8 << 20, 0):
        monkeypatch.setattr(threat, "BROADCAST_BYTES", limit)
        bad = by(threat.ip_first_seen(fl, feed, threat.MALICIOUS_IP), "ip")
        # Spelling decides what has been seen already, not what is listed.
        assert {ip: (r["ts"], r["direction"]) for ip, r in bad.items()} == {
            "6.6.6.6": (at(0), "destination"), "FE80::A": (at(3), "source"), "fe80::a": (at(3), "destination")}
        assert [r.dst_port for r in threat.ip_first_seen(fl, feed, threat.TOR_NODE).collect()] == [1]
        assert sorted(r.domain for r in threat.domain_contacts(fl, feed).collect()) == ["EVIL.com", "evil.com"]


def test_declared_rules(spark):
    fl = flows(spark, [
        *[row(i, src_ip="udp", protocol="UDP", dst_port=i) for i in range(20)],
        *[row(i, src_ip="web", dst_port=443, status_code=401 + 2 * (i % 2)) for i in range(10)],
        *[row(i, src_ip="web2", dst_port=443, status_code=500) for i in range(10)],
        *[row(i, src_ip=f"c{i}", dst_ip="flooded", flags="SYN") for i in range(10)],
        *[row(0.5, dst_ip="flooded", flags="SYN,ACK") for _ in range(2)],
        *[row(i, src_ip="dns", protocol="UDP", dst_port=53, domain="a" * 50) for i in range(30)],
        *[row(i, src_ip="dns2", protocol="UDP", dst_port=53, domain="a" * 49) for i in range(30)],
        row(0, src_ip="mis", protocol="HTTP", dst_port=81), row(0, src_ip="mis", protocol="HTTP", dst_port=8080),
        row(0, src_ip="mis", protocol="SSH", dst_port=2222), row(1, src_ip="mis", protocol="SSH", dst_port=2222),
        row(0, dst_ip="pinged", protocol="ICMP", packets=4000), row(10, dst_ip="pinged", protocol="ICMP", packets=1000),
        row(0, dst_ip="calm", protocol="ICMP", packets=4000), row(11, dst_ip="calm", protocol="ICMP", packets=1000),
    ])
    assert set(by(declared.udp_scan(fl), "src_ip")) == {"udp"}
    assert set(by(declared.http_bruteforce(fl), "src_ip")) == {"web"}
    flood = by(declared.syn_flood(fl, min_syn=2), "dst_ip")
    # One SYN, then two answers: the ratio of 5 needs ten SYN; the answers leave after 30 s.
    assert (flood["flooded"]["syn_count"], flood["flooded"]["synack_count"], flood["flooded"]["last_ts"]) == (10, 2, at(9))
    assert set(by(declared.dns_tunnel(fl), "src_ip")) == {"dns"}
    wrong = by(declared.proto_mismatch(fl), "protocol", "dst_port")
    assert {k: r["events"] for k, r in wrong.items()} == {("HTTP", 81): 1, ("SSH", 2222): 2}
    assert set(by(declared.icmp_flood(fl), "dst_ip")) == {"pinged"}
    rules = [
        {"id": "A", "name": "a", "conditions": {"protocol": ["UDP"], "dst_port": 53, "count_min": 30, "time_window_seconds": 29}},
        {"id": "B", "name": "b", "conditions": {"status_code": [401, 403], "bytes_sent_min": 0}},
        {"id": "C", "name": "c", "enabled": False, "conditions": {}},
    ]
    got = declared.threshold_rules(fl, rules).groupBy("rule_id", "src_ip").count().collect()
    assert {(r.rule_id, r.src_ip): r["count"] for r in got} == {("A", "dns"): 1, ("A", "dns2"): 1, ("B", "web"): 10}
    with pytest.raises(ValueError):
        declared.threshold_rules(fl, [{"id": "D", "name": "d", "conditions": {"colour": "red"}}])
