"""Rule presets. Names, limits and texts are fixed values; windows are parameters.

The presets fit a live radio (windows of a minute). ``scaled`` gives the same
rules with the windows a 30-day record needs.
"""

from __future__ import annotations

from dataclasses import replace

from wavetrail.operators import filters as P
from wavetrail.operators.rules import Rule

# The alert presets.
ALERT_PRESETS = [
    Rule(1, "Encrypted Activity Burst", "threshold", (P.Eq("encrypted", True),), 60, "gte", 5.0, cooldown_sec=300, priority="HIGH"),
    Rule(2, "New Emitter Detected", "first_occurrence", (P.Eq("event_type", "sigex.emitter.new"),), cooldown_sec=60, priority="MEDIUM"),
    Rule(3, "SDR Disconnected", "first_occurrence", (P.Eq("event_type", "system.sdr.disconnect"),), cooldown_sec=10, priority="CRITICAL"),
    Rule(4, "Signal Lost (No Spectrum)", "absence", (P.Eq("event_type", "spectrum.detect"),), 30, cooldown_sec=60, priority="HIGH"),
    Rule(5, "Federal Activity Detected", "first_occurrence", (P.Eq("classification", "FEDL"),), cooldown_sec=120, priority="HIGH"),
    Rule(6, "P25 Grant Spike", "threshold", (P.Eq("event_type", "protocol.p25.grant"),), 60, "gte", 20.0, cooldown_sec=300, priority="MEDIUM"),
    Rule(7, "Crypto Key Rotation", "first_occurrence", (P.Eq("event_type", "sigex.crypto.rotation"),), cooldown_sec=60, priority="HIGH"),
    Rule(8, "High Event Rate", "rate_change", (), 60, percent=300.0, baseline_sec=3600, cooldown_sec=600, priority="MEDIUM"),
]

# The derived-event presets.
EVENT_PRESETS = [
    Rule(
        11, "Federal Burst Detector", "threshold", (P.Eq("classification", "FEDL"),), 120, "gte", 3.0, cooldown_sec=300,
        event_type="custom.fedl_burst", severity=13, body_template="{{count}} federal signals on {{freqs}} in {{bands}}",
    ),
    Rule(
        12, "New Talkgroup Spotter", "new_value", (P.Eq("event_type", "protocol.p25.grant"),), baseline_sec=86400, field="talkgroup",
        cooldown_sec=60, event_type="custom.new_talkgroup", severity=11, body_template="New talkgroup activity: TG {{talkgroups}}",
    ),
    Rule(
        13, "Multi-Band Radio Unit", "cardinality", (P.Exists("source_unit"),), 600, "gte", 3.0, field="band", cooldown_sec=600,
        event_type="custom.multiband_uid", severity=13, body_template="UID {{uids}} active on {{count}} bands: {{bands}}",
    ),
    Rule(
        14, "Encrypted Traffic Tagger", "every", (P.Eq("event_type", "protocol.p25.voice"), P.Eq("encrypted", True)), cooldown_sec=0,
        event_type="custom.encrypted_voice", severity=9, body_template="Encrypted voice on TG {{talkgroups}} at {{freqs}}",
    ),
    Rule(
        15, "Spectrum Silence Alert", "absence", (P.Eq("event_type", "spectrum.detect"),), 60, cooldown_sec=120,
        event_type="custom.spectrum_silence", severity=17, body_template="No spectrum activity detected for 60s",
    ),
]


def scaled(rule: Rule, **changes) -> Rule:
    return replace(rule, **changes)
