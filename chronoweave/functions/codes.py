"""Fixed values of the clinical source: item codes, patterns and product factors."""

# ---------------------------------------------------------------- fixed values: readings
CHART_ITEMS = (807, 811, 1529, 3744, 3745, 220621, 225664, 226537)
LAB_ITEMS = (50809, 50931)
FINGERSTICK_ITEMS = (807, 811, 1529, 225664)
BLOOD_ITEMS = (3745, 50809, 50931, 220621, 226537)  # 3744 is scanned but belongs to neither list
FINGERSTICK_BELOW = 500
BLOOD_BELOW = 1000

# ---------------------------------------------------------------- fixed values: insulin
INSULIN_TYPES = {
    223257: "Intermediate",
    223258: "Short",
    223259: "Intermediate",
    223260: "Long",
    223261: "Intermediate",
    223262: "Short",
}
INJECTION_PATTERN = "%NON IV%"
PUSH_PATTERN = "%MED BOLUS%"
INFUSION_CATEGORIES = ("01-Drips", "12-Parenteral Nutrition")
STOPPED_STATES = ("Paused", "Stopped")
REWRITTEN = "Rewritten"

# ---------------------------------------------------------------- fixed values: parenteral nutrition
PARENTERAL_ITEMS = (
    220949, 220950, 220952, 225801, 225916, 225917, 225947, 225948, 225969, 227090, 228140, 228141, 228142,
)
# grams of dextrose per ml; the last four are rated but not among the scanned items
DEXTROSE_SHARE = {
    220949: 0.05, 220950: 0.1, 220952: 0.5, 228140: 0.2, 228141: 0.3, 228142: 0.4,
    225823: 0.05, 225825: 0.05, 225827: 0.05, 225941: 0.05,
}
DEXTROSE_SOLUTIONS = (220949, 220950, 220952, 228140, 228141, 228142)
LIPID_SHARE = {225801: 0.2, 227090: 0.1}
TPN_WITH_LIPIDS = 225916
TPN_WITHOUT_LIPIDS = 225917
DEXTROSE_TPN = 225947
LIPIDS_TPN = 225969
AMINO_ACIDS_TPN = 225948

# ---------------------------------------------------------------- fixed values: enteral nutrition
ENTERAL_ITEMS = {
    "Boost Glucose Control": (227976, 227977, 227978, 227979),
    "Enlive": (228352, 228353, 228354, 228355),
    "Ensure": (225937, 226875, 226876, 227091),
    "Ensure Plus": (226877, 226878, 226879, 227092),
    "Fibersource HN": (227695, 227696, 227697, 227698, 227699),
    "Glucerna": (228356, 228357, 228358, 228359),
    "Impact": (221207, 226020, 226021, 226022, 226023),
    "Impact with Fiber": (225928, 226024, 226025, 226026, 226027),
    "Isosource 1.5": (228131, 228132, 228133, 228134, 228135),
    "Nepro": (228348, 228349, 228350, 228351),
    "NovaSource Renal": (227972, 227973, 227974, 227975),
    "Nutren 2.0": (225931, 226016, 226017, 226018, 226019, 227518),
    "Nutren Pulmonary": (226880, 226881, 226882),
    "Nutren Renal": (221036, 226028, 226029, 226030, 226031),
    "Peptamen 1.5": (225930, 226036, 226037, 226038, 226039),
    "Peptamen Bariatric": (228383,),
    "Peptamen VHP": (227370, 227371, 227372, 227373, 227374),
    "ProBalance": (225929, 226040, 226041, 226042, 226043),
    "Pulmocare": (228360, 228361, 228362, 228363),
    "Replete": (225935, 226044, 226045, 226046, 226047),
    "Replete with Fiber": (225936, 226048, 226049, 226050, 226051),
    "Two Cal HN": (228364, 228365, 228366, 228367),
    "Vivonex": (225934, 226056, 226057, 226058, 226059),
}
NUTRIENTS = ("cho", "dextrose", "fat", "protein", "fibre", "calorie")
# per ml of product, in the order of NUTRIENTS
ENTERAL_FACTORS = {
    "Boost Glucose Control": (0.067510549, 0.016877637, 0.029535865, 0.067510549, None, 0.801687764),
    "Enlive": (0.189873418, 0.092827004, 0.046413502, 0.084388186, None, 1.476793249),
    "Ensure": (0.139240506, 0.063291139, 0.025316456, 0.037974684, None, 0.928270042),
    "Ensure Plus": (0.202531646, 0.092827004, 0.046413502, 0.067510549, None, 1.476793249),
    "Fibersource HN": (0.156118143, 0.010126582, 0.04092827, 0.054008439, None, 1.223628692),
    "Glucerna": (0.11, 0.029, 0.034, 0.0465, None, 0.93),
    "Impact": (0.132, None, 0.028, 0.056, None, 1.0),
    "Impact with Fiber": (0.132, None, 0.028, 0.056, None, 1.0),
    "Isosource 1.5": (0.167088608, 0.081012658, 0.064135021, 0.064978903, None, 1.518987342),
    "Nepro": (0.147272727, 0.031818182, 0.097727273, 0.080909091, None, 1.822727273),
    "NovaSource Renal": (0.184810127, 0.076793249, 0.1, 0.091139241, None, 2.0),
    "Nutren 2.0": (0.196, 0.036, 0.092, 0.08, None, 2.0),
    "Nutren Pulmonary": (0.1, 0.048, 0.0948, 0.068, None, 1.5),
    "Nutren Renal": (0.184810127, 0.076793249, 0.1, 0.091139241, None, 2.004219409),
    "Peptamen 1.5": (0.188, None, 0.056, 0.068, None, 1.5),
    "Peptamen Bariatric": (0.078, None, 0.038, 0.0932, None, 1.0),
    "Peptamen VHP": (0.076, 0.0, 0.038, 0.092, None, 1.0),
    "ProBalance": (None, None, None, None, None, None),
    "Pulmocare": (0.105485232, None, 0.093248945, 0.062447257, None, 1.497890295),
    "Replete": (0.112, None, 0.034, 0.064, None, 1.0),
    "Replete with Fiber": (0.124, 0.04, 0.034, 0.064, None, 1.0),
    "Two Cal HN": (0.21, 0.046, 0.089, 0.084, None, 1.995),
    "Vivonex": (0.00256, 0.00256, 0.004, 0.044, 0.0, 1.212),
}

# ---------------------------------------------------------------- fixed values: cohort and reports
ZERO_FILLED = (
    "input_bolus_push", "input_bolus_injection", "input_hrs",
    "enteral_rate", "cho_enteral", "dextrose_enteral", "fat_enteral", "protein_enteral", "fibre_enteral",
    "calorie_enteral", "tpn_rate", "dextrose_fluid",
)
DOSE_COLUMNS = ("input_hrs", "input_bolus_injection", "input_bolus_push")
DOSE_LIMIT = 50.0
DISPLAY_NAMES = {
    "LinearModel": "LinearModel",
    "Catboost": "Catboost",
    "BoostedTrees": "Boosted trees",
    "GRUModel": "TimeGap-GRU",
    "DecayGRUModel": "Decay-GRU",
    "ODEGRUModel": "ODE-GRU",
    "FlowGRUModel": "Flow-GRU",
    "LSTMModel": "TimeGap-LSTM",
    "ODELSTMModel": "ODE-LSTM",
    "FlowLSTMModel": "Flow-LSTM",
    "IMODE": "IMODE",
}
METRICS = (
    "crps_mean", "ig_mean", "int_score_mean", "var_pit", "int_coverage", "int_av_width", "int_med_width", "rmse",
)
