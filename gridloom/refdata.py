"""Fixed values of the engineering domain."""

from __future__ import annotations

#: Fixed values. Diameter table: mm, capacity t/h, largest length m, cost per m.
DIAMETERS = (
    (50, 3.5, 181.0, 74023), (65, 8.3, 245.0, 78631), (80, 13.2, 327.0, 83530), (100, 22.3, 419.0, 89748), (125, 40.2, 554.0, 97275), (150, 65.1, 696.0, 105507),
    (200, 152.3, 1042.0, 120275), (250, 274.9, 1379.0, 135323), (300, 437.4, 1718.0, 150022), (400, 943.1, 2477.0, 190299), (500, 1663.4, 3245.0, 224137), (600, 2627.7, 4037.0, 264790),
    (700, 3735.1, 4775.0, 324298), (800, 5296.8, 5644.0, 325996), (900, 7165.0, 6518.0, 327693), (1000, 9391.8, 7419.0, 418777), (1200, 15012.8, 9288.0, 428074), (1400, 22501.9, 11276.0, 683417),
)
#: Fixed values. Final price per m up to a diameter, and beyond the last.
STEP_PRICES = ((100, 3780), (125, 4050), (150, 4590), (200, 5580), (250, 6840), (300, 8370), (400, 11070), (500, 13860), (600, 16740), (700, 19530), (800, 22410), (900, 25200), (1000, 28080), (1200, 33660))
PRICE_BEYOND = 39330
#: Fixed values. Chamber cost up to a diameter, and beyond the last; cost of a tie-in.
CHAMBER_COSTS = ((200, 3_000_000), (500, 5_000_000), (1000, 8_000_000))
CHAMBER_BEYOND, TIE_IN_COST = 12_000_000, 5_000_000
#: Fixed values. Restriction types: crossing forbidden, special pass allowed, distance m, least angle, cost factor.
RESTRICTIONS = {
    "road": (False, True, 1.5, 45.0, 1.60), "tram_tracks": (False, True, 1.5, 45.0, 1.75), "gas_pipeline": (False, True, 2.0, None, 1.25), "power_cable": (False, True, 2.0, None, 1.15), "heat_network": (False, True, 1.0, None, 1.05),
    "water": (True, False, 1.0, None, None), "park": (True, False, 1.0, None, None), "social_area": (True, False, 1.0, None, None), "prohibited_site": (True, False, 1.0, None, None), "railway": (True, False, 1.0, None, None), "oks": (True, False, None, None, None),
}
#: Fixed values. Types of features; shares and units of the score; penalties of an unconnected consumer; radius of clusters and tie-ins, most candidates and attachments.
OBJECT_TYPES = ("source", "heat_network", "heat_chamber", "oks_connection_point", "restriction")
COST_SHARE, COST_UNIT, LENGTH_SHARE, LENGTH_UNIT = 0.7, 25e6, 0.3, 100.0
PENALTY_FIXED, PENALTY_FLOW = 1e8, 5e5
CLUSTER_RADIUS, TIE_IN_RADIUS, MOST_CANDIDATES, MOST_ATTACHMENTS = 150.0, 1000.0, 20, 4


def case_up_to(value: str, steps, beyond) -> str:
    """SQL of a step function."""
    return "CASE " + " ".join(f"WHEN {value} <= {a} THEN {b}" for a, b in steps) + f" ELSE {beyond} END"


def oks_distance(diameter: int) -> float:
    """Fixed values. Distance to buildings by pipe diameter."""
    return 5.0 if diameter < 500 else 7.0 if diameter <= 800 else 9.0
