"""Tables and defaults that results depend on."""

#: Base failure probability by component type; other types never fail.
BASE_FAILURE = {
    "Source": 0.1, "Sink": 0.0, "PowerToGas": 0.1, "PowerToHeat": 0.1, "CHP": 0.1, "GasToPower": 0.1, "PowerGenerator": 0.1,
    "HeatExchanger": 0.1, "HeatExchangerGenerator": 0.1, "HeatExchangerLoad": 0.1, "GenericPowerBranch": 0.1, "PowerLine": 0.1,
    "Trafo": 0.0, "WaterPipe": 0.1, "GasPipe": 0.1, "Bus": 0.0, "Junction": 0.0,
}
#: Carrier group by component type.
CARRIER = {
    "Source": "gas", "Sink": "gas", "PowerToGas": "multi", "PowerToHeat": "multi", "CHP": "multi", "PowerGenerator": "electricity",
    "HeatExchanger": "heat", "HeatExchangerLoad": "heat", "GenericPowerBranch": "electricity", "WaterPipe": "heat", "GasPipe": "gas",
    "Bus": "electricity", "Junction": "heat/gas", "PowerToHeatControlNode": "multi", "CHPControlNode": "multi",
    "GenericTransferBranch": "multi", "PowerLoad": "electricity", "ExtPowerGrid": "electricity", "ExtHydrGrid": "gas",
}
#: Component types by the name of the group that charts show together.
TYPE_GROUPS = {
    "branches": ("GenericPowerBranch", "WaterPipe", "GasPipe"),
    "nodes": ("PowerGenerator", "Source", "HeatExchanger"),
    "CPs": ("PowerToHeat", "CHP", "PowerToGas"),
    "power lines": ("GenericPowerBranch",),
    "gas pipes": ("GasPipe",),
    "water pipes": ("WaterPipe",),
}
#: Scenario names by power-heat-gas-mes impact.
SCENARIO = {"0-0-0-3": "high cp", "0-0-3-0": "high gas", "0-3-0-0": "high heating", "3-0-0-0": "high electricity", "1-1-1-1": "low overall", "2-2-2-2": "medium overall"}
#: Performance columns by carrier code.
CARRIER_CODE = {"0": "electricity", "1": "heat", "2": "gas"}
METRICS = ("betweenness_centrality", "degree", "vc", "katz")
SMALL = 1e-11
#: Damage coefficient by type: the attribute it is read from; 1 for a constant.
DAMAGE_ATTRIBUTE = {
    "Source": "mass_flow", "Sink": "mass_flow", "PowerToGas": "to_mass_flow", "PowerToHeat": "heat_energy_mw", "CHP": "mass_flow",
    "GasToPower": "from_mass_flow", "PowerGenerator": "p_mw", "HeatExchanger": "q_w", "HeatExchangerGenerator": "q_w",
    "HeatExchangerLoad": "q_w", "GenericPowerBranch": "br_r", "PowerLine": "br_r", "Trafo": "1", "WaterPipe": "length_m",
    "GasPipe": "length_m", "Bus": "1", "Junction": "1",
}
#: attribute, target, relative deviation allowed
BOUNDS = (("vm_pu", 1.0, 0.1), ("pressure_pu", 1.0, 0.1), ("t_pu", 1.0, 0.1), ("loading_percent", 1.0, 1.0))
#: Shift of a network chart's points by layer: x, y; the last is that of nodes without a known layer.
LAYER_SHIFT = {"power": (0.0, 0.0), "heat": (0.0003, 0.0003), "gas": (0.0006, 0.0006), "None": (0.0003, -0.0003)}
RUNS_PER_PROCESS = 2000
