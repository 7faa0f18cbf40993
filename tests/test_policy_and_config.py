from types import SimpleNamespace

import pytest

from tidelog.config import StoreConfig
from tidelog.errors import InvalidConfigurationError
from tidelog.plans.compaction import SizeTieredPolicy, never


def levels(**counts):
    return {int(k[1:]): [SimpleNamespace(run_id=f"{k}{i}", level=int(k[1:]), count=10) for i in range(n)] for k, n in counts.items()}


def test_shallowest_full_level_goes_one_down():
    plan = SizeTieredPolicy(3, 2)(levels(L0=3, L1=3))
    assert plan.input_ids == ["L00", "L01", "L02"] and plan.target_level == 1 and not plan.drop_tombstones and plan.entry_count == 30


def test_tombstones_go_at_the_bottom_only():
    policy = SizeTieredPolicy(2, 2)
    assert [policy(levels(**{f"L{n}": 2})).drop_tombstones for n in range(3)] == [False, False, True]


def test_nothing_is_dropped_above_a_deeper_level():
    plan = SizeTieredPolicy(2, 1)(levels(L1=2, L3=1))
    assert plan.target_level == 1 and not plan.drop_tombstones
    assert SizeTieredPolicy(2, 1)(levels(L3=2)).target_level == 3


def test_no_plan():
    assert SizeTieredPolicy(3, 2)(levels(L0=2, L1=2)) is None and SizeTieredPolicy(3, 2)({}) is None and never(levels(L0=9)) is None


@pytest.mark.parametrize("bad", [{"buffer_capacity": 0}, {"max_runs_per_level": 1}, {"bottom_level": 0}, {"bits_per_key": 0}, {"hash_count": 17}, {"name": "a/b"}])
def test_settings_out_of_range(bad):
    with pytest.raises(InvalidConfigurationError):
        StoreConfig(**bad)


def test_policy_validates():
    for bad in ((1, 1), (2, 0)):
        with pytest.raises(InvalidConfigurationError):
            SizeTieredPolicy(*bad)


def test_hashes_follow_the_bits():
    assert [StoreConfig(bits_per_key=b).hashes for b in (1, 10, 12, 100)] == [1, 7, 8, 16] and StoreConfig(hash_count=3).hashes == 3


def test_unknown_setting():
    with pytest.raises(InvalidConfigurationError):
        StoreConfig.of("x", {"colour": 1})
