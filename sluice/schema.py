"""Explicit schemas (DDL) of the canonical tables."""

from __future__ import annotations

ACCOUNTS = (
    "account_id string, bank_id string, open_date date, kyc_tier string, archetype string, district string, "
    "device_fingerprint string, home_ip_prefix string, prior_activity_date date, exit_kind string"
)
TRANSACTIONS = (
    "txn_id string, src string, dst string, amount double, timestamp timestamp_ntz, channel string, "
    "device_fingerprint string, ip_prefix string, is_fraud boolean, ring_id string"
)
LABELS = (
    "account_id string, is_mule boolean, ring_id string, layer_index int, is_cashout_node boolean, typology string"
)
EPISODES = (
    "episode_id string, ring_id string, typology string, victim_account string, amount_inr double, "
    "start_time timestamp_ntz, scenario_id string"
)
DATASET = {"accounts": ACCOUNTS, "transactions": TRANSACTIONS, "labels": LABELS, "episodes": EPISODES}

EVENTS = ("event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string")

CASE_DOCUMENT = (
    "case_id bigint, victim struct<account_id:bigint,amount_inr:double>, "
    "accounts array<struct<id:bigint,bank:bigint,kyc_tier:string>>, "
    "truth map<bigint,boolean>, "
    "transfers array<struct<src:bigint,dst:bigint,amount_inr:double,t_offset_sec:bigint>>, "
    "cashout_events array<struct<account_id:bigint,amount_inr:double,t_offset_sec:bigint>>"
)
