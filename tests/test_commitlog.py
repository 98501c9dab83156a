"""Commit log and model store: numbered once, compacted, readable beside commits."""

import threading
import time

import pytest

from kestrel.streaming.commitlog import CommitConflict, CommitLog
from kestrel.streaming.modelstore import ModelStore, State


def test_records_are_put_once_and_compacted(spark, scratch):
    log = CommitLog(spark, f"{scratch}/log", bucket=4)
    assert log.newest() is None and log.records("added array<string>").count() == 0
    for k in range(18):
        log.append(k, {"seq": k, "added": [f"a{k}"]})
    assert log.newest() == (17, {"seq": 17, "added": ["a17"]})
    with pytest.raises(CommitConflict):
        log.append(17, {"seq": 17, "added": ["other"]})
    rows = log.records("added array<string>").orderBy("seq").collect()
    assert [(r["seq"], r["added"]) for r in rows] == [(k, [f"a{k}"]) for k in range(18)]
    assert log._names("compact") == [f"{k:012d}.json" for k in range(3)]
    log.vacuum()                       # young: nothing goes
    assert len(log._buckets()) == 5
    log.vacuum(age_ms=0)
    assert len(log._buckets()) == 2 and log.records("added array<string>").count() == 18 and log.newest()[0] == 17


def test_attempts_that_no_commit_names_are_not_versions(spark, scratch):
    store = ModelStore(spark, f"{scratch}/m", "a")
    state = store.start([0.0, 0.0])
    store.write_versions([(0, "s", 0, [0], 5, 5, [9.0, 9.0])], "s-0")     # its trainer died before the commit
    assert [r["version"] for r in store.versions().collect()] == [-1]
    again = store.write_versions([(0, "s", 0, [0], 5, 5, [1.0, 2.0])], "s-0")
    store.commit(State(seq=state.seq, version=0, weights=[1.0, 2.0], n_seen=5, added=[again]))
    assert [(r["version"], r["weights"]) for r in store.versions().orderBy("version").collect()] == [
        (-1, [0.0, 0.0]), (0, [1.0, 2.0])]
    assert store.history().count() == 2


def test_two_trainers_of_one_model_cannot_both_commit(spark, scratch):
    one, two = (ModelStore(spark, f"{scratch}/m", "a") for _ in range(2))
    a, b = one.start([0.0]), two.start([0.0])
    one.commit(State(seq=a.seq, version=0, weights=[1.0]))
    with pytest.raises(CommitConflict):
        two.commit(State(seq=b.seq, version=0, weights=[2.0]))
    assert two.state().weights.tolist() == [1.0]


def test_reads_beside_commits_never_fail_and_never_go_back(spark, scratch):
    store = ModelStore(spark, f"{scratch}/m", "a")
    store.log.bucket = 5
    store.start([0.0])
    failures, seen, stop = [], [], threading.Event()

    def read(versions: bool):
        last = -1
        while not stop.is_set():
            try:
                now = ModelStore(spark, f"{scratch}/m", "a")
                now.log.bucket = 5
                s = now.state()
                assert s.seq >= last and s.weights.tolist() == [float(max(s.seq, 0))]
                last = s.seq
                if versions:
                    n = now.versions().count()
                    assert n >= s.seq + 1
                seen.append(last)
            except Exception as e:  # noqa: BLE001 - any failure counts
                failures.append(repr(e)[:300])
                return

    readers = [threading.Thread(target=read, args=(k == 0,)) for k in range(3)]
    for r in readers:
        r.start()
    end, k = time.time() + 25, 0
    while time.time() < end:
        k += 1
        name = store.write_versions([(k - 1, "s", k, [k], 1, k, [float(k)])], f"s-{k}")
        store.commit(State(seq=k - 1, version=k - 1, weights=[float(k)], n_seen=k, added=[name]))
    stop.set()
    for r in readers:
        r.join()
    assert not failures and k > 20 and len(seen) > 20 and store.versions().count() == k + 1
