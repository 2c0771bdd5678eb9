"""Names, codes, bands and libraries the results depend on.

Everything here is a constant of the domain, stated as text in natural order.
"""

from __future__ import annotations

# Event types with their display names.
EVENT_NAMES = [
    ("spectrum.detect", "Signal Detected"),
    ("spectrum.lost", "Signal Lost"),
    ("spectrum.anomaly", "Spectrum Anomaly"),
    ("protocol.p25.voice", "P25 Voice"),
    ("protocol.p25.grant", "P25 Voice Grant"),
    ("protocol.p25.update", "P25 Grant Update"),
    ("protocol.p25.register", "P25 Unit Register"),
    ("protocol.p25.deregister", "P25 Unit Deregister"),
    ("protocol.p25.affiliation", "P25 Group Affiliation"),
    ("protocol.p25.deny", "P25 Deny Response"),
    ("protocol.p25.adjacent", "P25 Adjacent Site"),
    ("protocol.p25.cc_status", "P25 CC Status"),
    ("protocol.p25.net_status", "P25 Network Status"),
    ("protocol.p25.rfss_status", "P25 RFSS Status"),
    ("protocol.p25.chan_params", "P25 Channel Params"),
    ("protocol.rds.update", "RDS Metadata"),
    ("protocol.same.alert", "SAME Weather Alert"),
    ("sigex.emitter.new", "New Emitter"),
    ("sigex.emitter.return", "Returning Emitter"),
    ("sigex.uid.mismatch", "UID Mismatch"),
    ("sigex.crypto.rotation", "Crypto Key Rotation"),
    ("sigex.traffic.session", "Traffic Session"),
    ("sigex.protocol.new_uid", "New Radio UID"),
    ("sigex.network.event", "Network Event"),
    ("sigex.network.emergency", "Emergency Grant"),
    ("sigex.network.deny", "Access Denied"),
    ("sigex.anomaly.baseline", "Baseline Anomaly"),
    ("system.sdr.connect", "SDR Connected"),
    ("system.sdr.disconnect", "SDR Disconnected"),
    ("system.sdr.error", "SDR Error"),
    ("system.gps.fix", "GPS Fix"),
    ("system.mode.change", "Mode Change"),
    ("system.operation.start", "Operation Started"),
    ("system.operation.stop", "Operation Stopped"),
    ("system.recording.start", "Recording Started"),
    ("system.recording.stop", "Recording Stopped"),
    ("system.clip.start", "P25 Clip Started"),
    ("system.clip.end", "P25 Clip Ended"),
    ("system.site.enter", "Site Entered"),
    ("system.site.exit", "Site Exited"),
    ("system.alert.fired", "Alert Fired"),
]

# Event types shown to the operator; the rest is housekeeping.
TACTICAL_EVENTS = [
    "protocol.p25.voice",
    "sigex.traffic.session",
    "sigex.emitter.new",
    "sigex.emitter.return",
    "sigex.uid.mismatch",
    "sigex.crypto.rotation",
    "sigex.network.emergency",
    "sigex.network.deny",
    "sigex.anomaly.baseline",
    "sigex.protocol.new_uid",
    "protocol.same.alert",
    "system.alert.fired",
    "system.sdr.error",
    "system.sdr.disconnect",
    "system.mode.change",
    "system.site.enter",
    "system.site.exit",
]

# Severity label and the highest code it covers.
SEVERITY_LABELS = [
    (2, "TRACE"), (6, "DEBUG"), (10, "INFO"), (12, "NOTICE"), (16, "WARN"), (20, "ERROR"), (255, "FATAL"),
]
# Source codes.
SOURCE_LABELS = [(0, "SPECTRUM"), (1, "PROTOCOL"), (2, "SIGEX"), (3, "SYSTEM"), (4, "AUDIO"), (5, "CUSTOM")]

# Repeater outputs and cellular bands in MHz.
REPEATER_RANGES = [
    (145.1, 145.5), (146.61, 146.97), (147.0, 147.39), (440.0, 444.975),
    (462.55, 462.725), (453.0, 454.0), (460.0, 461.0), (851.0, 869.0),
]
CELLULAR_RANGES = [(700.0, 960.0), (1700.0, 2100.0), (2500.0, 2700.0)]

# Named bands (key, start MHz, end MHz, label); some overlap.
BANDS = [
    ("AM", 0.530, 1.700, "AM 530-1700k"),
    ("HF", 3.0, 30.0, "HF 3-30"),
    ("FM", 88.0, 108.0, "FM 88-108"),
    ("VHF", 136.0, 174.0, "VHF 136-174"),
    ("FEDV", 163.0, 173.0, "FEDV 163-173"),
    ("BIII", 174.0, 230.0, "BIII 174-230"),
    ("UHF", 400.0, 512.0, "UHF 400-512"),
    ("GMRS", 462.0, 467.7125, "GMRS 462-467"),
    ("P25", 769.0, 860.0, "P25 769-860"),
]

# Encryption algorithms (name, id, short name).
ALGORITHMS = [
    ("Unencrypted", 0x80, "CLEAR"),
    ("DES-OFB", 0x81, "DES"),
    ("3DES", 0x83, "3DES"),
    ("AES-256", 0x84, "AES"),
    ("Accordion", 0xAA, "ADP"),
    ("ADP", 0xAA, "ADP"),
]
CLEAR_ALGORITHM = 0x80

# Emitter library (name, type, freq MHz min/max, PRI us min/max, pulse width us min/max).
EMITTERS = [
    (1, "WSR-88D NEXRAD", "WEATHER_RADAR", 2700.0, 3000.0, 750.0, 3100.0, 1.5, 4.7),
    (2, "ASR-9 Airport Surveillance", "AIRPORT_RADAR", 2700.0, 2900.0, 1000.0, 1300.0, 1.0, 1.2),
    (3, "ASR-11 DASR", "AIRPORT_RADAR", 2700.0, 2900.0, 833.0, 1000.0, 1.0, 1.2),
    (4, "Marine X-band Radar", "MARINE_RADAR", 9300.0, 9500.0, 500.0, 1500.0, 0.07, 1.0),
    (5, "Marine S-band Radar", "MARINE_RADAR", 2900.0, 3100.0, 500.0, 1500.0, 0.3, 1.0),
    (6, "ARSR-4 Air Route Surveillance", "ATC_RADAR", 1215.0, 1350.0, 2000.0, 4000.0, 2.0, 4.0),
    (7, "TDWR Terminal Doppler", "WEATHER_RADAR", 5600.0, 5650.0, 500.0, 1000.0, 1.1, 2.0),
    (8, "Speed Radar (X-band)", "TRAFFIC_RADAR", 10500.0, 10550.0, None, None, None, None),
    (9, "Speed Radar (K-band)", "TRAFFIC_RADAR", 24050.0, 24250.0, None, None, None, None),
    (10, "Speed Radar (Ka-band)", "TRAFFIC_RADAR", 33400.0, 36000.0, None, None, None, None),
]

# Drone signatures (order, maker, model, ranges MHz, bandwidth MHz).
DRONES = [
    (1, "DJI", "OcuSync 2 (Mavic 2/Mini 2/Air 2)", [(2400.0, 2483.5), (5725.0, 5850.0)], 10.0),
    (2, "DJI", "OcuSync 3 (Mini 3/Air 3/Mavic 3)", [(2400.0, 2483.5), (5725.0, 5850.0)], 10.0),
    (3, "DJI", "FPV (analog 5.8 GHz)", [(5645.0, 5945.0)], 20.0),
    (4, "Autel", "EVO II series", [(2400.0, 2483.5), (5725.0, 5850.0)], 10.0),
    (5, "FPV/DIY", "ExpressLRS (ELRS 900 MHz)", [(902.0, 928.0)], 0.5),
    (6, "FPV/DIY", "ExpressLRS (ELRS 2.4 GHz)", [(2400.0, 2483.5)], 1.0),
]

# Oscillator frequencies (MHz as listed) behind harmonic groups.
OSCILLATORS = [
    (0.012, "USB 1.1 (12 MHz)"),
    (0.025, "HDMI pixel clock (25 MHz)"),
    (0.027, "Crystal (27 MHz)"),
    (0.048, "USB 2.0 (48 MHz)"),
    (0.100, "Crystal (100 MHz)"),
    (0.480, "USB 2.0 HS (480 MHz)"),
]

# Department classes, first matching keyword set wins (where, keywords, class).
DEPARTMENT_RULES = [
    ("tag", ["law", "corrections"], "PUBS"),
    ("tag", ["fire", "ems", "emergency"], "PUBS"),
    ("tag", ["interop"], "PUBS"),
    ("department", ["police", "sheriff"], "PUBS"),
    ("department", ["fire", "ems", "rescue"], "PUBS"),
    ("department", ["trimet", "transit"], "COMM"),
    ("department", ["hospital", "medical"], "COMM"),
    ("department", ["federal"], "FEDL"),
    ("department", ["port of portland"], "PUBS"),
    ("department", ["water", "transportation", "public works"], "COMM"),
]

# Alert event codes (code, name, severity).
ALERT_CODES = [
    ("EAN", "Emergency Action Notification", "Extreme"),
    ("EAT", "Emergency Action Termination", "Extreme"),
    ("NIC", "National Information Center", "Extreme"),
    ("TOR", "Tornado Warning", "Extreme"),
    ("EWW", "Extreme Wind Warning", "Extreme"),
    ("TSW", "Tsunami Warning", "Extreme"),
    ("SVR", "Severe Thunderstorm Warning", "Severe"),
    ("FFW", "Flash Flood Warning", "Severe"),
    ("WSW", "Winter Storm Warning", "Severe"),
    ("BZW", "Blizzard Warning", "Severe"),
    ("HWW", "High Wind Warning", "Severe"),
    ("HUW", "Hurricane Warning", "Severe"),
    ("FRW", "Fire Warning", "Severe"),
    ("SSW", "Storm Surge Warning", "Severe"),
    ("SMW", "Special Marine Warning", "Severe"),
    ("DSW", "Dust Storm Warning", "Severe"),
    ("SQW", "Snow Squall Warning", "Severe"),
    ("ISW", "Ice Storm Warning", "Severe"),
    ("CEM", "Civil Emergency Message", "Severe"),
    ("LAE", "Local Area Emergency", "Severe"),
    ("LEW", "Law Enforcement Warning", "Severe"),
    ("CDW", "Civil Danger Warning", "Severe"),
    ("EVI", "Evacuation Immediate", "Severe"),
    ("SPW", "Shelter in Place Warning", "Severe"),
    ("NUW", "Nuclear Power Plant Warning", "Severe"),
    ("RHW", "Radiological Hazard Warning", "Severe"),
    ("VOW", "Volcano Warning", "Severe"),
    ("HMW", "Hazardous Materials Warning", "Severe"),
    ("CAE", "Child Abduction Emergency", "Severe"),
    ("BLU", "Blue Alert", "Severe"),
    ("FLW", "Flood Warning", "Moderate"),
    ("SVA", "Severe Thunderstorm Watch", "Moderate"),
    ("TOA", "Tornado Watch", "Moderate"),
    ("WNT", "Winter Storm Watch", "Moderate"),
    ("WSA", "Winter Storm Watch", "Moderate"),
    ("HUA", "Hurricane Watch", "Moderate"),
    ("SSA", "Storm Surge Watch", "Moderate"),
    ("FFA", "Flash Flood Watch", "Moderate"),
    ("FLA", "Flood Watch", "Moderate"),
    ("HWA", "High Wind Watch", "Moderate"),
    ("FZW", "Freeze Warning", "Moderate"),
    ("WCW", "Wind Chill Warning", "Moderate"),
    ("EHW", "Excessive Heat Warning", "Moderate"),
    ("HEA", "Heat Advisory", "Minor"),
    ("FOG", "Dense Fog Advisory", "Minor"),
    ("DFA", "Dense Fog Advisory", "Minor"),
    ("WCA", "Wind Chill Advisory", "Minor"),
    ("FZA", "Freeze Watch", "Minor"),
    ("WIY", "Wind Advisory", "Minor"),
    ("FRY", "Frost Advisory", "Minor"),
    ("HTA", "Heat Advisory", "Minor"),
    ("UPY", "Heavy Freezing Spray Warning", "Minor"),
    ("SPS", "Special Weather Statement", "Minor"),
    ("FLS", "Flood Statement", "Minor"),
    ("FFS", "Flash Flood Statement", "Minor"),
    ("AVW", "Avalanche Warning", "Minor"),
    ("AVA", "Avalanche Watch", "Minor"),
    ("BHW", "Biological Hazard Warning", "Minor"),
    ("CFA", "Coastal Flood Watch", "Minor"),
    ("CFW", "Coastal Flood Warning", "Minor"),
    ("DSA", "Dust Advisory", "Minor"),
    ("EQW", "Earthquake Warning", "Minor"),
    ("TSA", "Tsunami Watch", "Minor"),
    ("RWT", "Required Weekly Test", "Test"),
    ("RMT", "Required Monthly Test", "Test"),
    ("NPT", "National Periodic Test", "Test"),
    ("DMO", "Practice/Demo Warning", "Test"),
    ("ADR", "Administrative Message", "Info"),
    ("NMN", "Network Message Notification", "Info"),
]

# County codes (state + county digits, county, state) and known states.
COUNTIES = [
    ("41001", "Baker", "OR"), ("41003", "Benton", "OR"), ("41005", "Clackamas", "OR"), ("41007", "Clatsop", "OR"),
    ("41009", "Columbia", "OR"), ("41011", "Coos", "OR"), ("41013", "Crook", "OR"), ("41015", "Curry", "OR"),
    ("41017", "Deschutes", "OR"), ("41019", "Douglas", "OR"), ("41021", "Gilliam", "OR"), ("41023", "Grant", "OR"),
    ("41025", "Harney", "OR"), ("41027", "Hood River", "OR"), ("41029", "Jackson", "OR"),
    ("41031", "Jefferson", "OR"), ("41033", "Josephine", "OR"), ("41035", "Klamath", "OR"), ("41037", "Lake", "OR"),
    ("41039", "Lane", "OR"), ("41041", "Lincoln", "OR"), ("41043", "Linn", "OR"), ("41045", "Malheur", "OR"),
    ("41047", "Marion", "OR"), ("41049", "Morrow", "OR"), ("41051", "Multnomah", "OR"), ("41053", "Polk", "OR"),
    ("41055", "Sherman", "OR"), ("41057", "Tillamook", "OR"), ("41059", "Umatilla", "OR"), ("41061", "Union", "OR"),
    ("41063", "Wallowa", "OR"), ("41065", "Wasco", "OR"), ("41067", "Washington", "OR"), ("41069", "Wheeler", "OR"),
    ("41071", "Yamhill", "OR"),
    ("53011", "Clark", "WA"), ("53015", "Cowlitz", "WA"), ("53039", "Klickitat", "WA"), ("53049", "Pacific", "WA"),
    ("53059", "Skamania", "WA"), ("53069", "Wahkiakum", "WA"),
]
STATES = [("41", "OR"), ("53", "WA"), ("06", "CA"), ("16", "ID")]


def sql_values(rows, columns: str, alias: str) -> str:
    """The constant table as a CTE, so that SQL checks share the constants."""

    def lit(v):
        if v is None:
            return "NULL"
        if isinstance(v, str):
            return "'" + v.replace("'", "''") + "'"
        return f"{v}::DOUBLE" if isinstance(v, float) else str(v)

    body = ", ".join("(" + ", ".join(lit(v) for v in r) + ")" for r in rows)
    return f"{alias}({columns}) AS (VALUES {body})"
