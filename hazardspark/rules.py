"""Vocabularies, weights and thresholds as data."""

# fixed values: vocabularies in their order, steps and thresholds
EVENT_TYPES = ["RAIN", "FLOOD", "THUNDERSTORM", "HEATWAVE", "FOG", "DUST_STORM", "STRONG_WIND"]
EVENT_STATUSES = ["DETECTED", "CORROBORATING", "NEEDS_REVIEW", "VERIFIED", "REJECTED", "RESOLVED"]
WARNING_LEVELS = ["GREEN", "YELLOW", "ORANGE", "RED"]
ALERT_STATUSES = ["ACTIVE", "ACKNOWLEDGED", "CLOSED"]
SEVERITY_STEPS = [(5, "LOW"), (15, "MODERATE"), (30, "HIGH")]
WARNING_STEPS = [("RED", 25, 4, 0.62), ("ORANGE", 10, 3, 0.50), ("YELLOW", 0, 2, 0.38)]
FLAGGED_CAP = 0.5
EARTH_RADIUS_M = 6371008.8
# fixed values: trust in a source by its type
SOURCE_TRUST = {"GOVERNMENT": 1.0, "WEATHER_API": 1.0, "SATELLITE": 0.9, "WEB_RSS": 0.7, "CITIZEN": 0.6, "SOCIAL": 0.5}
UNKNOWN_TRUST = 0.5
# fixed values: words that speak for a type, matched as substrings
KEYWORDS = {
    "RAIN": ["rain", "rainfall", "showers", "drizzle", "downpour", "monsoon", "बारिश", "बरसात", "વરસાદ"],
    "FLOOD": ["flood", "flooding", "waterlogging", "water logging", "inundation", "submerged", "overflowing", "बाढ़", "जलभराव", "પૂર"],
    "THUNDERSTORM": ["thunderstorm", "lightning", "thunder", "squall", "hailstorm", "hail", "गरज", "बिजली", "વીજળી"],
    "HEATWAVE": ["heatwave", "heat wave", "scorching", "sweltering", "heat stroke", "loo", "गर्मी", "लू", "ગરમી"],
    "FOG": ["fog", "foggy", "mist", "visibility", "smog", "कोहरा", "ધુમ્મસ"],
    "DUST_STORM": ["dust storm", "duststorm", "dust", "sandstorm", "आंधी", "धूल", "ધૂળ"],
    "STRONG_WIND": ["strong wind", "gusty wind", "gusts", "wind speed", "high winds", "तेज हवा", "પવન"],
}
SCORE_FLOOR = 0.02
FLAT_SCORE = 0.1429
# fixed values: tags that are followed
TRACKED_HASHTAGS = ["imd", "imdweather", "weather", "weatherupdate", "weatheralert", "rain", "rains", "rainfall", "monsoon", "flood", "flooding", "waterlogging", "thunderstorm", "lightning", "heatwave", "fog", "duststorm", "cyclone", "imdalert", "ndma", "mausam"]
# fixed values: weights of credibility flags, in their order
FLAG_WEIGHTS = {"CONTRADICTED_BY_OBSERVATION": 0.40, "UNCORROBORATED": 0.20, "LOW_TRUST_SOURCE": 0.15, "UNRESOLVED_LOCATION": 0.10, "NO_WEATHER_SIGNAL": 0.25, "DUPLICATE_CONTENT": 0.10}
LOW_TRUST = 0.55
COARSE_LOCATION = 0.35
REVIEW_RISK = 0.50
# fixed values: wording of headlines and bulletins
PHRASES = {"RAIN": "Heavy rainfall", "FLOOD": "Flooding", "THUNDERSTORM": "Thunderstorm activity", "HEATWAVE": "Heatwave conditions", "FOG": "Dense fog", "DUST_STORM": "Dust storm", "STRONG_WIND": "Strong winds"}
SITUATIONS = {
    "RAIN": "Heavy rainfall is being reported",
    "FLOOD": "Waterlogging and flooding are being reported",
    "THUNDERSTORM": "Thunderstorm activity with lightning is being reported",
    "HEATWAVE": "Heatwave conditions are being reported",
    "FOG": "Dense fog with reduced visibility is being reported",
    "DUST_STORM": "A dust storm with reduced visibility is being reported",
    "STRONG_WIND": "Strong winds are being reported",
}
EXPECT = {
    "RAIN": "Localised waterlogging, slow traffic and possible disruption to commuting.",
    "FLOOD": "Water entering low-lying areas, roads becoming impassable and vehicles stranded.",
    "THUNDERSTORM": "Lightning strikes, sudden gusts, and brief power interruptions.",
    "HEATWAVE": "High daytime temperatures with raised risk of heat exhaustion and heat stroke.",
    "FOG": "Sharply reduced visibility affecting road, rail and air travel, especially at dawn.",
    "DUST_STORM": "Poor visibility, airborne dust and deteriorating air quality.",
    "STRONG_WIND": "Falling hoardings and branches, and hazardous conditions at sea.",
}
SAFETY = {
    "RAIN": ["Avoid low-lying and waterlogged areas.", "Do not shelter under trees or near electric poles.", "Allow extra travel time and drive slowly."],
    "FLOOD": ["Do not attempt to cross flooded roads, on foot or by vehicle.", "Move to higher ground if water is entering your premises.", "Switch off the mains supply before water reaches electrical fittings.", "Keep drinking water covered and use only safe or boiled water."],
    "THUNDERSTORM": ["Stay indoors and away from windows until the storm passes.", "Avoid open fields, isolated trees and water bodies.", "Unplug electrical appliances where possible."],
    "HEATWAVE": ["Avoid direct sun between 12 noon and 3 pm.", "Drink water frequently even if not thirsty; use ORS or lemon water.", "Check on elderly neighbours, outdoor workers and young children.", "Never leave children or pets in parked vehicles."],
    "FOG": ["Postpone non-essential travel during early morning hours.", "Use fog lights and maintain a wide gap from the vehicle ahead.", "Check flight and train status before leaving for the terminal."],
    "DUST_STORM": ["Stay indoors and keep windows closed.", "Cover your nose and mouth if you must go outside.", "Pull over safely and wait if visibility drops while driving."],
    "STRONG_WIND": ["Secure loose objects, hoardings and rooftop items.", "Keep clear of old trees, billboards and temporary structures.", "Fishermen should not venture out to sea."],
}
SITUATIONS_HI = {
    "RAIN": "भारी वर्षा की सूचना मिल रही है",
    "FLOOD": "जलभराव और बाढ़ जैसी स्थिति की सूचना मिल रही है",
    "THUNDERSTORM": "गरज के साथ बिजली गिरने की सूचना मिल रही है",
    "HEATWAVE": "लू की स्थिति की सूचना मिल रही है",
    "FOG": "घने कोहरे और कम दृश्यता की सूचना मिल रही है",
    "DUST_STORM": "धूल भरी आँधी और कम दृश्यता की सूचना मिल रही है",
    "STRONG_WIND": "तेज़ हवाओं की सूचना मिल रही है",
}
ACTIONS = {"GREEN": "No action needed", "YELLOW": "Watch — be updated", "ORANGE": "Alert — be prepared", "RED": "Warning — take action"}
ACTIONS_HI = {"GREEN": "कोई कार्रवाई आवश्यक नहीं", "YELLOW": "सतर्क रहें", "ORANGE": "तैयार रहें", "RED": "कार्रवाई करें"}
CONFIDENCE_NOTES = {
    "high": "This advisory is supported by multiple independent sources.",
    "medium": "This advisory is based on partially corroborated reports.",
    "low": "This advisory is based on limited reports and is still being verified.",
}
# fixed values: what a headline must name, and what rules it out
WEATHER_TERMS = ["rain", "rainfall", "flood", "cyclone", "storm", "thunder", "lightning", "monsoon", "imd", "heatwave", "heat wave", "temperature", "fog", "visibility", "wind", "gale", "downpour", "waterlog", "cloudburst", "landslide", "alert", "warning", "weather"]
EXCLUDE_TERMS = ["odi", "t20", "test match", "ipl", "world cup", "asian games", "olympic", "innings", "wicket", "stadium", "vs ", " vs", "fixture", "match", "tournament", "playoff", "league", "home search", "real estate", "property price", "stocks", "shares", "sensex", "nifty"]
# fixed values: words that are no place by themselves
PLACE_STOPWORDS = ["india", "central", "union", "national", "high", "mall", "market", "north", "south", "east", "west", "city", "town", "district", "state", "river", "hills", "point", "fort", "road", "park", "garden", "colony", "nagar", "pur", "bazar", "bazaar", "sector", "line", "lines", "camp", "gola", "kot", "bank", "post", "well", "mile", "cross", "gate", "power"]
PLACE_CONFIDENCE = {"town": 0.55, "district": 0.45, "state": 0.30}
JITTER_DEGREES = 0.05
SEMANTIC_DUPLICATE, FUZZY_DUPLICATE = 0.82, 0.85
DUPLICATE_RADIUS_M, DUPLICATE_MINUTES, HASH_HOURS, FUZZY_NEWEST = 10_000, 30, 2, 80
PIPELINE_STATES = ["RECEIVED", "NORMALIZED", "ENRICHED", "CLASSIFIED", "CLUSTERED", "FAILED"]
CLUSTER_RADIUS_M = 15000.0
CLUSTER_MINUTES = 90
STALE_HOURS = 6
MAX_ATTEMPTS = 3
OFF_TOPIC = 0.5  # fixed value: from this probability on a text is no report
# fixed wording: why a level was given, and why an alert was closed
REASON_SHUT, REASON_COUNTS, REASON_SOURCES = "event %s by review", "%s reports from %s independent sources, evidence %s", "%s independent sources corroborating"
REASON_NONE, REASON_VERIFIED, REASON_AGREES = "insufficient independent corroboration", "verified by a human reviewer", "observed weather agrees (%s)"
REASON_CAP, REASON_CALMER = "most contributing reports flagged for credibility", "event de-escalated to %s"
AGREEMENT = 0.6
