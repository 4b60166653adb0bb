"""Vocabularies the extraction functions work with; every one is a parameter of the function that uses it.

The lists under "Fixed values" hold the words, patterns, factors and limits on which results depend.
"""

# Topics and the patterns that count for them, matched without regard to case.
TOPICS = {
    "laser": ["laser", "beam", "welding", "cladding", "additive", "3d printing", "selective laser", "slm", "sls", "direct energy deposition", "ded"],
    "microstructure": ["microstructure", "grain", "phase", "texture", "precipitate", "defect", "dislocation", "twin", "morphology"],
    "multicomponent alloys": ["multicomponent", "high entropy", "hea", "cca", "complex concentrated", "alloy design", "compositionally complex"],
    "heat source models": ["heat source", "thermal model", "gaussian", "rosenthal", "goldak", "moving heat source", "thermal efficiency"],
    "thermal history": ["thermal history", "cooling rate", "thermal cycle", "temperature gradient", "thermal gradient", "heating rate"],
    "multiscale models": ["multiscale", "multiscale modeling", "scale bridging", "hierarchical", "multi-scale"],
    "artificial intelligence": ["artificial intelligence", "ai", "neural network", "deep learning", "expert system", "knowledge representation"],
    "machine learning": ["machine learning", "ml", "supervised", "unsupervised", "reinforcement", "regression", "classification", "clustering"],
    "featurization": ["featurization", "feature engineering", "descriptor", "fingerprint", "representation learning"],
    "molecular dynamics": ["molecular dynamics", "md simulation", "atomistic", "interatomic potential", "empirical potential"],
    "dft": ["density functional", "dft", "first principles", "ab initio", "quantum mechanics", "electronic structure"],
    "phase field method": ["phase field", "phase-field", "order parameter", "ginzburg-landau", "cahn-hilliard", "allen-cahn"],
    "micrographs": ["micrograph", "sem", "tem", "ebsd", "optical microscopy", "om", "scanning electron", "transmission electron", "electron backscatter"],
    "XRD": ["x-ray diffraction", "xrd", "diffraction pattern", "bragg's law", "crystallography", "rietveld"],
    "properties": ["mechanical properties", "tensile", "hardness", "yield strength", "ductility", "toughness", "fatigue", "creep", "fracture"],
}

# Processes and the words that name them.
PROCESSES = {
    "SLM": ["selective laser melting", "slm"], "LPBF": ["laser powder bed fusion", "l-pbf", "lpbf", "pbf-lb"], "LSA": ["laser surface alloying", "lsa"], "EBM": ["electron beam melting", "ebm"],
    "DED": ["directed energy deposition", "ded", "lmd"], "PFI": ["port fuel injection", "pfi"], "GDI": ["gasoline direct injection", "gdi", "disi"], "FEM": ["finite element method", "fem", "fea"],
    "MD": ["molecular dynamics", "md", "lammps"], "PFM": ["phase field method", "pfm", "cahn-hilliard"], "CALPHAD": ["calphad", "thermocalc", "pycalphad", "tdb"], "PINN": ["physics-informed neural network", "pinn"],
    "UNET": ["u-net", "unet"], "CONVLSTM": ["convlstm", "conv-lstm"], "DIGITAL_TWIN": ["digital twin", "vdt", "virtual twin"], "XAI": ["explainable ai", "xai", "shap"], "UQ": ["uncertainty quantification", "uq"],
    "TENSOR_DECOMP": ["tucker decomposition", "cp decomposition", "parafac", "tensorly"], "TFIDF_PMI": ["tf-idf", "pointwise mutual information", "pmi", "ner"],
}

# Quantities in the order in which they are tried.
QUANTITY_NAMES = """
laser_power electrical_power scan_speed flow_speed feed_rate irradiance temperature melting_temperature energy_density areal_energy_density linear_energy_density layer_thickness
spot_size exposure_time yield_strength tensile_strength ultimate_tensile_strength hardness elongation modulus youngs_modulus poisson_ratio coefficient_thermal_expansion
corrosion_potential pitting_potential repassivation_potential breakdown_potential open_circuit_potential corrosion_current_density current_density polarization_resistance PREN
phase_fraction austenite_fraction ferrite_fraction grain_size cell_size porosity relative_density surface_roughness stacking_fault_energy unstable_stacking_fault_energy
ideal_shear_strength sauter_mean_diameter spray_penetration plume_height film_thickness absorption_coefficient enthalpy viscosity thermal_conductivity density lewis_number
jackson_parameter meltpool_depth meltpool_width hatch_distance rotation_angle work_hardening_rate hollomon_strength hollomon_exponent ramberg_osgood_k ramberg_osgood_n
plasticity_model phase_field_method molecular_dynamics digital_twin pinn unet convlstm calphad xai uncertainty_quantification bimodal_microstructure martensitic_transformation
eigenstrain marangoni_effect boussinesq_approximation lead_lag_dynamics positional_time_lag solute_clustering grain_boundary_energy diffuse_interface_width common_tangent
phase_stability surface_tension mass_diffusivity thermal_diffusivity specific_heat_capacity latent_heat_fusion nucleation_rate growth_rate spinodal_temperature
martensite_start_temperature
""".split()
#: Words that name a quantity besides its own name.
SYNONYMS = {
    "laser_power": ["beam power", "laser output"], "scan_speed": ["scanning speed", "scan velocity", "travel speed"], "melting_temperature": ["melting point", "liquidus"], "energy_density": ["volumetric energy"],
    "areal_energy_density": ["fluence", "areal energy"], "linear_energy_density": ["line energy"], "layer_thickness": ["layer height"], "spot_size": ["spot diameter", "beam diameter", "beam waist"],
    "exposure_time": ["dwell time", "pulse duration"], "yield_strength": ["yield stress", "proof stress"], "tensile_strength": ["tensile stress"], "hardness": ["microhardness", "vickers"], "youngs_modulus": ["young's modulus", "elastic modulus"],
    "corrosion_current_density": ["corrosion current"], "phase_fraction": ["volume fraction"], "grain_size": ["grain diameter", "mean intercept"], "porosity": ["pore fraction", "void fraction"], "surface_roughness": ["roughness"],
    "hatch_distance": ["hatch spacing"], "meltpool_depth": ["melt pool depth", "pool depth"], "meltpool_width": ["melt pool width"], "density": ["specific mass"], "thermal_conductivity": ["heat conductivity"],
    "digital_twin": ["virtual twin"], "phase_field_method": ["phase field"], "martensitic_transformation": ["martensite"], "marangoni_effect": ["marangoni"], "temperature": ["preheat"],
}
QUANTITY_RULES = [(q, [q.replace("_", " ").lower(), *SYNONYMS.get(q, [])]) for q in QUANTITY_NAMES]
# Exact abbreviations of a parameter's name.
ABBREVIATIONS = {"p": "laser_power", "vs": "scan_speed", "ys": "yield_strength", "uts": "ultimate_tensile_strength", "hv": "hardness", "t": "temperature", "ved": "energy_density", "sfe": "stacking_fault_energy", "smd": "sauter_mean_diameter", "rp": "polarization_resistance", "ecorr": "corrosion_potential", "epit": "pitting_potential", "ocp": "open_circuit_potential", "le": "lewis_number", "cte": "coefficient_thermal_expansion", "ra": "surface_roughness", "k": "thermal_conductivity"}
# Fixed values: (word of the context, parts of the unit, quantity).
UNIT_AND_CONTEXT = [("yield", ["mpa"], "yield_strength"), ("tensile", ["mpa"], "tensile_strength"), ("corrosion", ["mv", "v"], "corrosion_potential"), ("current", ["a/cm2", "ua", "ma"], "current_density"), ("polarization", ["ohm", "ω"], "polarization_resistance")]
#: Parts of a unit that tell a quantity, in order.
UNIT_HINTS = [
    ("scan_speed", ["mm/s", "m/s", "mm/min"]), ("irradiance", ["w/cm"]), ("thermal_conductivity", ["w/m", "w/(m"]), ("laser_power", ["kw", "mw"]), ("areal_energy_density", ["j/cm2", "j/cm²"]), ("energy_density", ["j/mm3", "j/mm³", "j/cm3"]),
    ("linear_energy_density", ["j/mm", "j/m"]), ("stacking_fault_energy", ["mj/m2", "mj/m²"]), ("yield_strength", ["mpa", "gpa"]), ("hardness", ["hv", "hrc"]), ("exposure_time", ["ns", "ps", "fs", "µs"]), ("grain_size", ["µm", "um"]),
    ("density", ["g/cm3", "kg/m3", "g/cm³", "kg/m³"]), ("corrosion_potential", ["mv"]), ("porosity", ["%"]), ("specific_heat_capacity", ["j/kg", "j/g"]), ("enthalpy", ["j/mol"]), ("viscosity", ["pa·s", "pa s"]),
]
# Last rules, by the unit as a whole or its parts.
LAST_UNITS = [(["w", "kw", "mw"], True, "laser_power"), (["mm/s"], False, "scan_speed"), (["c", "k"], False, "temperature"), (["mpa", "gpa"], False, "hardness")]

#: Label and units of each quantity of the pattern bank: "label = number unit" or "label: number unit".
_LENGTH, _STRESS, _VOLT = "µm|um|nm|mm", "MPa|GPa|psi", "mV|V"
BANK = {
    "laser_power": ("laser +power|power|P", "W|kW|mW"), "scan_speed": ("scan(?:ning)? +speed|Vs", "mm/s|cm/s|m/s|mm/min"), "yield_strength": ("yield +strength|YS|proof stress", _STRESS), "tensile_strength": ("tensile +strength|UTS", _STRESS),
    "hardness": ("hardness|HV|Vickers", "HV|MPa|GPa"), "temperature": ("temperature|T", "°C|K|°F"), "energy_density": ("(?:volumetric +)?energy +density|VED", "J/mm³|J/mm3|J/cm³|J/cm3"), "corrosion_potential": ("Ecorr|corrosion potential|OCP", _VOLT),
    "pitting_potential": ("Epit|pitting potential", _VOLT), "repassivation_potential": ("Erp|repassivation potential", _VOLT), "breakdown_potential": ("Ebr|breakdown potential", _VOLT), "corrosion_current_density": ("Jcorr|corrosion current density", "µA/cm²|uA/cm2|mA/cm2|A/cm2"),
    "polarization_resistance": ("Rp|polarization resistance", "ohm·cm2|Ω·cm²"), "PREN": ("PREN", ""), "stacking_fault_energy": ("SFE|stacking fault energy", "mJ/m²|mJ/m2|J/m2"), "sauter_mean_diameter": ("SMD|Sauter mean diameter", _LENGTH),
    "density": ("density|ρ", "g/cm³|g/cm3|kg/m³|kg/m3"), "thermal_conductivity": ("thermal conductivity|k", "W/m·K|W/mK|W/\\(m·K\\)|W/\\(m K\\)"), "viscosity": ("viscosity|μ", "mPa·s|Pa·s|cP"), "enthalpy": ("enthalpy|H", "kJ/mol|J/mol|J/kg"),
    "elongation": ("elongation|strain to failure", "%|pct"), "phase_fraction": ("(?:austenite|ferrite|martensite) (?:fraction|content)", "%|vol%"), "grain_size": ("grain size|cell size", _LENGTH), "porosity": ("porosity|pore fraction", "%|fraction"),
    "relative_density": ("relative density", "%|fraction"), "lewis_number": ("Lewis number|Le", ""), "jackson_parameter": ("Jackson parameter|αj", ""), "meltpool_depth": ("melt ?pool depth|pool depth", _LENGTH), "work_hardening_rate": ("work hardening rate|θ", _STRESS),
    "hollomon_strength": ("strength coefficient|K", _STRESS), "hollomon_exponent": ("hardening exponent|n", ""), "ramberg_osgood_k": ("Ramberg-Osgood K", ""), "ramberg_osgood_n": ("Ramberg-Osgood n", ""), "meltpool_width": ("melt ?pool width|pool width", _LENGTH),
    "marangoni_velocity": ("Marangoni velocity", "mm/s|m/s"), "martensite_start_temperature": ("Ms|martensite start", "°C|K"), "spinodal_temperature": ("spinodal temperature|Tspin", "°C|K"), "nucleation_rate": ("nucleation rate", ""), "growth_rate": ("growth rate", "mm/s|µm/s|m/s"),
    "grain_boundary_energy": ("grain boundary energy", "J/m2|J/m²|mJ/m2"), "diffuse_interface_width": ("interface width", _LENGTH), "solute_cluster_size": ("cluster size", _LENGTH), "surface_tension": ("surface tension|γ", "N/m|mN/m"), "mass_diffusivity": ("mass diffusivity|D", "m2/s|m²/s|cm2/s"),
    "thermal_diffusivity": ("thermal diffusivity|α", "m2/s|m²/s|mm2/s"), "specific_heat_capacity": ("specific heat(?: capacity)?|Cp", "J/kgK|J/\\(kg·K\\)|J/gK"), "latent_heat_fusion": ("latent heat|L", "kJ/kg|J/kg|kJ/mol"), "phase_field_iterations": ("iterations", ""),
    "md_steps": ("steps|timesteps", ""), "fem_elements": ("elements", ""), "pinn_epochs": ("epochs", ""), "unet_dice": ("dice", ""), "convlstm_rmse": ("RMSE", ""), "eigenstrain": ("eigenstrain|misfit strain", ""), "boussinesq_density_variation": ("density variation", "%"),
    "lead_lag_time": ("lead time|lag time", "s|ms|µs"), "positional_time_lag": ("positional lag", "s|ms|µs"), "exchange_current_density": ("exchange current density|i0", "A/cm2|mA/cm2"), "tafel_slope": ("Tafel slope", "mV/dec|V/dec"), "charge_transfer_coefficient": ("charge transfer coefficient", ""), "diffusion_coefficient": ("diffusion coefficient", "m2/s|m²/s|cm2/s"),
}


def bank_pattern(quantity: str) -> str:
    """Pattern of the bank; its first group is the number."""
    label, units = BANK[quantity]
    head = r"(?:^|[^A-Za-z0-9_])"
    return rf"{head}(?:{label}) *[=:] *([+-]?[0-9]+(?:\.[0-9]+)?)" + (rf" *(?:{units})" if units else "")


#: Query-biased quantities: unit, plausible range, words of the context and names.
BIASED = {
    "laser_power": ("W", (1.0, 10000.0), ["laser", "beam", "processing", "ablation", "melting", "sintering", "welding", "cutting", "drilling", "surface"], ["power", "output"]),
    "scan_speed": ("mm/s", (0.1, 5000.0), ["scan", "scanning", "hatch", "raster", "speed", "velocity", "feed", "traversal", "beam path"], ["scan speed", "scanning speed", "travel speed"]),
    "fluence": ("J/cm2", (0.001, 1000.0), ["fluence", "threshold", "ablation", "pulse", "energy", "damage"], ["fluence"]),
    "wavelength": ("nm", (100.0, 11000.0), ["wavelength", "laser", "emission", "infrared", "visible", "source"], ["wavelength"]),
    "pulse_duration": ("ns", (0.000001, 1000000.0), ["pulse", "duration", "width", "femtosecond", "picosecond", "nanosecond"], ["pulse duration", "pulse width"]),
    "repetition_rate": ("kHz", (0.001, 100000.0), ["repetition", "frequency", "rate", "pulse"], ["repetition rate", "frequency"]),
    "spot_size": ("um", (0.1, 5000.0), ["spot", "focus", "diameter", "beam", "waist"], ["spot size", "spot diameter", "beam diameter"]),
    "hatch_distance": ("um", (1.0, 1000.0), ["hatch", "spacing", "line", "overlap"], ["hatch distance", "hatch spacing"]),
    "layer_thickness": ("um", (1.0, 1000.0), ["layer", "thickness", "powder", "build"], ["layer thickness"]),
    "pulse_energy": ("uJ", (0.001, 1000000.0), ["pulse", "energy", "single"], ["pulse energy"]),
    "roughness": ("um", (0.001, 1000.0), ["roughness", "surface", "finish", "topography"], ["roughness"]),
    "porosity": ("%", (0.0, 100.0), ["porosity", "pore", "void", "density", "defect"], ["porosity"]),
}
# Spellings of one unit, and units of one dimension.
UNIT_ALIASES = [["w", "watt", "watts"], ["um", "µm", "micron", "microns", "micrometer"], ["nm", "nanometer", "nanometers"], ["mm", "millimeter", "millimeters"], ["fs", "femtosecond", "femtoseconds"], ["ps", "picosecond", "picoseconds"], ["ns", "nanosecond", "nanoseconds"], ["khz", "kilohertz"], ["mhz", "megahertz"], ["j/cm²", "j/cm2", "j/cm^2"], ["%", "percent", "percentage"]]
UNIT_DIMENSIONS = [["w", "mw", "kw"], ["nm", "um", "µm", "mm", "cm", "m"]]


def biased_pattern(quantity: str) -> str:
    """A name of the quantity near a number with its unit, in either order."""
    unit, _, _, names = BIASED[quantity]
    spelled = next((a for a in UNIT_ALIASES if unit.lower() in a), [unit.lower()])
    u, n = "|".join(sorted(spelled, key=lambda x: (-len(x), x))).replace("^", "\\^"), "|".join(names)
    return rf"(?:{n})[^.0-9]{{0,30}}[0-9]+(?:\.[0-9]+)? *(?:{u})|[0-9]+(?:\.[0-9]+)? *(?:{u}) +(?:{n})"


# Base unit and factors of the unit tables, by lower-cased unit with plain exponents; that makes "mw" a megawatt.
UNIT_FACTORS = {
    "laser_power": ("W", {"w": 1.0, "kw": 1e3, "mw": 1e6}), "pulse_energy": ("J", {"j": 1.0, "mj": 1e-3, "µj": 1e-6, "uj": 1e-6, "nj": 1e-9}), "wavelength": ("nm", {"nm": 1.0, "um": 1000.0, "µm": 1000.0, "mm": 1e6, "m": 1e9}),
    "fluence": ("J/cm2", {"j/cm2": 1.0, "mj/cm2": 1e-3}), "scan_speed": ("mm/s", {"mm/s": 1.0, "mm/min": 1 / 60, "m/s": 1000.0, "m/min": 1000 / 60}), "spot_size": ("µm", {"µm": 1.0, "um": 1.0, "nm": 1e-3, "mm": 1000.0}),
    "pulse_duration": ("fs", {"fs": 1.0, "ps": 1e3, "ns": 1e6, "ms": 1e9}), "repetition_rate": ("kHz", {"hz": 1e-3, "khz": 1.0, "mhz": 1e3, "ghz": 1e6}), "roughness": ("nm", {"nm": 1.0, "µm": 1e3, "um": 1e3, "mm": 1e6}),
    "component_fraction": ("at%", {"at%": 1.0, "wt%": 1.0, "at.%": 1.0, "wt.%": 1.0}), "interfacial_energy": ("mJ/m2", {"j/m2": 1000.0, "mj/m2": 1.0}), "thermal_conductivity": ("W/(m·K)", {"w/(mk)": 1.0, "w/mk": 1.0}),
    "yield_strength": ("MPa", {"mpa": 1.0, "gpa": 1000.0}), "hardness": ("HV", {"hv": 1.0, "hrc": 0.1, "hb": 0.1}), "youngs_modulus": ("GPa", {"gpa": 1.0, "mpa": 0.001}),
}
# Plausible ranges.
PLAUSIBLE = {"laser_power": (1e-3, 1e5), "pulse_energy": (1e-12, 10.0), "wavelength": (100.0, 11000.0), "fluence": (1e-4, 1000.0), "scan_speed": (0.01, 5000.0), "spot_size": (0.1, 5000.0), "pulse_duration": (10e-15, 10e-9), "repetition_rate": (0.1, 10000.0), "roughness": (0.01, 100000.0), "component_fraction": (0.01, 100.0), "interfacial_energy": (1e-4, 5.0), "thermal_conductivity": (0.01, 400.0), "yield_strength": (50.0, 3000.0), "hardness": (30.0, 2500.0), "youngs_modulus": (10.0, 800.0)}
# Physical bounds of a stated quantity.
BOUNDS = {"temperature": (0.0, 10000.0), "energy_density": (0.0, 1000.0), "diffusion_coefficient": (0.0, 1e-3), "grain_size": (1e-9, 1e-2), "hardness": (0.0, 3000.0), "yield_strength": (0.0, 5000.0)}

# Classes of concepts, the first pattern that occurs wins.
CATEGORIES = [
    (r"alsi\d+mg|al(?:si|cu|mg|zn)\w*", "aluminum alloy"), (r"ti6al4v|ti(?:al|nb|mo)\w*", "titanium alloy"), (r"inconel\d+|ni(?:cr|mo|fe)\w*", "nickel alloy"), (r"cocrfeni|he[as]?|high.?entropy|mpea", "high-entropy alloy"),
    (r"snagcu|sac\d+|sn(?:ag|cu|bi|zn)\w*", "solder alloy"), (r"(?:laser\s*)?(?:power|energy\s*density|fluence|beam\s*intensity)", "laser energy parameter"), (r"(?:scan|travel)\s*speed|feed\s*rate", "scanning parameter"),
    (r"hatch\s*spacing|layer\s*thickness|point\s*distance", "geometric parameter"), (r"(?:columnar|equiaxed|dendritic|fine|coarse)\s*grain", "grain morphology"), (r"(?:martensite|austenite|eutectic|ferrite|precipitate)\s*(?:phase)?", "phase type"),
    (r"(?:micro|nano)hardness|hv\d*|vickers", "hardness metric"), (r"(?:tensile|yield|ultimate|fracture)\s*strength", "strength metric"), (r"(?:thermal\s*)?conductivity|diffusivity", "thermal property"), (r"(?:interfacial|grain\s*boundary)\s*energy", "interface property"),
    (r"(?:marangoni|convection|fluid\s*flow)", "melt pool dynamics"), (r"(?:porosity|void|crack|defect|spatter|keyhole)", "defect type"), (r"(?:phase\s*field|molecular\s*dynamics|finite\s*element|calphad)", "computational method"), (r"(?:digital\s*twin|machine\s*learning|neural\s*network|graph\s*neural)", "data-driven method"),
]
#: Words of the domain and of any study.
DOMAIN_WORDS = ["grain", "phase", "hardness", "strength", "elongation", "residual stress", "texture", "dendrite", "eutectic", "martensite", "austenite", "precipitate", "segregation", "porosity", "crack", "melt pool", "solidification", "nucleation", "laser power", "scan speed", "hatch spacing", "layer thickness", "energy density", "cooling rate", "absorptivity", "marangoni", "powder bed", "phase field", "molecular dynamics", "finite element"]
# Words of any study, which name no concept.
GENERIC_WORDS = ["study", "analysis", "effect", "role", "investigation", "research", "method", "approach", "paper", "work", "using"]
ALLOY_PATTERNS = [r"(?:[A-Z][a-z]?[0-9]+(?:\.[0-9]+)?){2,}", r"\b(?:Inconel|Corvanil|Nimbrax|Maradur|Ferrostan|Vitrumax|SS|UNS S)\s?[0-9]{2,5}[A-Z]?\b", r"[A-Za-z]+(?:-[A-Za-z]+)?\s?(?:alloy|superalloy|metal|composite)"]
# Names of equation models.
MODEL_ALIASES = {
    "hollomon power law": "hollomon", "hollomon powerlaw": "hollomon", "power law": "hollomon", "powerlaw": "hollomon", "hollomon equation": "hollomon", "ludwik equation": "hollomon", "swift equation": "hollomon", "ramberg osgood": "ramberg_osgood",
    "ramberg osgoood": "ramberg_osgood", "osgood": "ramberg_osgood", "ramberg": "ramberg_osgood", "elastoplastic": "ramberg_osgood", "cahn hilliard": "cahn_hilliard", "cahnhilliard": "cahn_hilliard", "phase field": "cahn_hilliard", "phasefield": "cahn_hilliard",
    "allen cahn": "cahn_hilliard", "allencahn": "cahn_hilliard", "butler volmer": "butler_volmer", "butlervolmer": "butler_volmer", "charge transfer": "butler_volmer", "tafel equation": "butler_volmer", "navier stokes": "navier_stokes", "navierstokes": "navier_stokes",
    "ns equations": "navier_stokes", "fick": "fick_diffusion", "ficks law": "fick_diffusion", "fickian": "fick_diffusion", "fourier": "fourier_heat", "fouriers law": "fourier_heat", "arrhenius": "arrhenius", "johnson cook": "johnson_cook", "johnsoncook": "johnson_cook",
    "voce": "voce", "voce equation": "voce", "ludwik": "ludwik",
}
# Ordered classes of materials and methods.
MATERIAL_CLASSES = [("multicomponent_alloy", ["hea", "mpea", "multicomponent", "cocrfeni", "alcocrfeni", "crmnfeconi"]), ("solder", ["solder", "snagcu", "sac"]), ("superalloy", ["inconel", "superalloy"]), ("steel", ["steel"]), ("titanium", ["titanium", "ti-"]), ("aluminum", ["aluminum", "al-"]), ("copper", ["copper"]), ("silicon", ["silicon"]), ("ceramic", ["ceramic", "alumina", "zirconia"]), ("polymer", ["polymer", "pmma", "polyimide"])]
METHOD_CLASSES = [("SLM/LPBF", ["slm", "lpbf", "powder bed"]), ("DED/Cladding", ["ded", "cladding", "deposition"]), ("Laser Soldering", ["soldering"]), ("Laser Ablation", ["ablation"]), ("Laser Welding", ["welding"]), ("Surface Structuring", ["structuring", "texturing", "lipss"]), ("Laser Annealing", ["annealing"])]
# Taxonomy of terms and the words that name a material.
TAXONOMY = {
    "Process Parameters": "laser_power current_density irradiance ved aed led time duration iterations digital_twin scan_speed hatch_spacing beam_diameter power velocity feed_rate lpbf".split(),
    "Mechanical Properties": "elongation hardness yield_strength youngs_modulus uts strain_rate nanoindentation plasticity sfe toughness fatigue_life creep_rate fracture_toughness modulus".split(),
    "Microstructural Features": "grain_size layer_thickness thickness density porosity material smd microstructural_similarity_index surface_roughness cell_size dendrite_spacing phase_fraction texture_index".split(),
    "Thermal / Fluid": "lewis_number prandtl_number thermal_conductivity diffusivity peclet_number marangoni_number reynolds_number".split(),
    "Computational / Method": [*"fem elastic_constant_calculation accuracy rmse mae r2_score convergence_rate".split(), "elastic constant calculation"],
    "Alloy / Composition": "alsimgzr ti-au ti3au heas_mpeas al al2cu nt_cu cu6sn5 au-ti ti-cr metallic_glass aln au ti cu fe ti6al4v ti2cu cu-mn sdss_2507 sdss strontium_titanate steel_sheet solder_interconnects tib2/alsimgzr al-si-mg-zr gold".split(),
    "Uncertainty / Unknown": ["unknown", "ambiguous", "unclassified"],
}
MATERIAL_INDICATORS = ["alloy", "imc", "matrix", "ceramic", "intermetallic", "metal", "glass", "solder"]
TERM_SYNONYMS = {"scanning_speed": "scan_speed", "scan speed": "scan_speed", "laser power": "laser_power", "beam power": "laser_power", "yield strength": "yield_strength", "proof stress": "yield_strength", "grain size": "grain_size", "young's modulus": "youngs_modulus", "thermal conductivity": "thermal_conductivity", "mass density": "density", "void fraction": "porosity"}

# Triggers of value extraction and ordered patterns of intents.
VALUE_TRIGGERS = [
    r"\bvalue\b", r"\bnumber\b", r"\bamount\b", r"\bquantity\b", r"\bhow much\b", r"\bhow many\b", r"\bwhat is the \w+ of\b", r"\bfind the\b.*\b(?:power|speed|strength|temperature|pressure|density|modulus|hardness)\b",
    r"\b\d+\s*(?:w|kw|mw|mm/s|mpa|gpa|k|°c|j/mm|µm|nm|mj/m²)", r"\btable\b.*\b(?:value|data|parameter)\b", r"\blist all\b.*\b(?:values|numbers|parameters)\b", r"\bparameter\b.*\b(?:value|list|table)\b", r"\bextract\b.*\b(?:number|value|data)\b",
    r"\bwhat\b.*\b(?:value|number|parameter)\b.*\bis\b", r"\bcompare\b.*\b(?:value|parameter|data)\b.*\bacross\b", r"\bhollomon\b", r"\bramberg[- ]osgood\b", r"\bcahn[- ]hilliard\b", r"\bbutler[- ]volmer\b", r"\bnavier[- ]stokes\b",
    r"\bparameters?\b.*\b(?:of|for)\b", r"\bcoefficient\b", r"\bexponent\b", r"\bconstant\b", r"\bflow\b.*\b(?:stress|curve)\b", r"\bhardening\b.*\b(?:exponent|rate|coefficient)\b", r"\bstrength\b.*\b(?:coefficient|parameter)\b",
]
INTENT_PATTERNS = {
    "equation": r"\b(?:equation|formula|governing|constitutive|navier[- ]stokes|boussinesq|marangoni|cahn[- ]hilliard|butler[- ]volmer|hollomon|ramberg[- ]osgood|derive|mathematical model|pde|partial\s+differential|schrodinger|maxwell|fick|fourier|arrhenius|johnson[- ]cook|voce|ludwik|swift)\b",
    "constitutive": r"\b(?:hollomon|ramberg[- ]osgood|ludwik|swift|voce|johnson[- ]cook|constitutive\s+(?:model|law|relation|equation|parameters?)|flow\s+stress|hardening\s+(?:law|model|rule)|yield\s+(?:criterion|surface|function)|strength\s+coefficient|hardening\s+exponent|strain\s+hardening)\b",
    "mechanism": r"\b(?:why|how does|mechanism|explain|cause|driving force|physical process|fluid flow|melt[- ]?pool\s+(?:dynamics|behavior|regime|formation)|porosity\s+formation|grain\s+growth|solidification|phase\s+transformation|recrystallization|nucleation|growth|segregation|thermal\s+cycle|residual\s+stress|what\s+happens|what\s+is\s+the\s+reason|describe\s+the\s+process)\b",
    "comparison": r"\b(?:compare|vs|versus|difference|across all|which is better|contrast|similarities|differences)\b|\bwhich\b.*\b(?:higher|lower|stronger|weaker|better|worse)\b|\brelative\b.*\b(?:performance|strength|behavior)\b",
    "sketch_diagram": r"\b(?:sketch|diagram|draw|visualize|schematic|flowchart|illustrate|process\s+flow|microstructure\s+image)\b|\bfigure\b.*\b(?:show|depict|display|present)\b|\bshow\b.*\b(?:process|setup|structure|microstructure)\b",
    "boolean": r"\b(?:is it|does|do|are there|can|was|were|has|have|is there|are they|mentioned)\b",
    "definition": r"\b(?:what is|what are|define|meaning of|definition of|describe|tell me about)\b",
}
OUTPUT_FORMATS = {"value_extraction": "table", "constitutive": "constitutive_hybrid", "equation": "latex", "sketch_diagram": "mermaid_or_ascii", "comparison": "contrastive_table", "mechanism": "causal_chain", "boolean": "yes_no_evidence"}
# Words of a query that tell its intent, in order, and the weights of intents.
QUERY_INTENTS = [("equation_hunting", ["equation", "model", "formula", "derive", "governing", "constitutive", "kinetics"]), ("mechanism_explanation", ["why", "how", "mechanism", "effect", "influence", "role", "explain", "cause"]), ("comparison", ["compare", "vs", "versus", "difference", "across all", "which is better", "contrast"]), ("boolean_verification", ["is it", "does", "do", "are there", "can", "mentioned"])]
QUERY_WEIGHTS = {"value_extraction": (0.8, 0.2, 0.3), "mechanism_explanation": (0.2, 0.7, 0.5), "comparison": (0.6, 0.4, 0.4), "boolean_verification": (0.5, 0.5, 0.2), "equation_hunting": (0.3, 0.7, 0.2)}
# Names of quantities in queries, and of what results are grouped by.
QUERY_QUANTITIES = [
    ("laser_power", ["laser power", "laserpower", "nominal power", "average power", "beam power", "power"]), ("fluence", ["fluence", "energy density", "threshold fluence"]), ("wavelength", ["wavelength", "lambda", "λ"]), ("pulse_duration", ["pulse duration", "pulse width", "pulse length", "fwhm", "pulse time"]),
    ("repetition_rate", ["repetition rate", "rep rate", "repetition frequency", "frequency"]), ("spot_size", ["spot size", "spot diameter", "beam radius", "beam waist", "focal spot", "spot"]), ("scan_speed", ["scan speed", "scanning speed", "travel speed", "writing speed", "scan rate"]), ("hatch_distance", ["hatch distance", "hatch spacing", "line spacing", "hatch"]),
    ("pulse_energy", ["pulse energy", "energy per pulse", "pulse power"]), ("roughness", ["roughness", "ra", "rms", "rq", "surface finish"]), ("periodicity", ["periodicity", "period", "spacing", "lsfl", "hsfl"]), ("threshold", ["threshold"]), ("interfacial_energy", ["interfacial energy", "surface tension", "interfacial tension", "surface energy"]),
    ("thermal_conductivity", ["thermal conductivity", "heat conductivity", "thermal diffusivity"]), ("component_fraction", ["composition", "at%", "wt%", "atomic percent", "weight percent", "concentration"]), ("yield_strength", ["yield strength", "yield stress", "ys", "σ_y"]), ("ultimate_tensile_strength", ["ultimate tensile strength", "uts", "tensile strength"]),
    ("youngs_modulus", ["young's modulus", "elastic modulus", "e modulus"]), ("viscosity", ["viscosity"]), ("enthalpy", ["enthalpy", "latent heat", "Δh"]), ("gibbs_free_energy", ["gibbs free energy", "free energy", "δg"]), ("energy_density", ["volumetric energy density", "ev"]), ("hardness", ["hardness", "vickers", "hv"]), ("cooling_rate", ["cooling rate", "solidification rate", "cooling speed"]),
]
DIMENSIONS = [("material", ["material", "alloy", "substrate", "metal", "composition", "system"]), ("document", ["document", "paper", "study", "article", "publication"]), ("method", ["method", "technique", "process", "setup", "approach"])]
CHARTS = [("pie", ["pie", "proportion", "percentage", "share"]), ("line", ["line", "trend", "over time"]), ("scatter", ["scatter", "vs", "versus", "against"]), ("heatmap", ["heatmap", "matrix", "co-occurrence"]), ("radar", ["radar", "spider", "profile"]), ("box", ["box", "boxplot", "distribution"]), ("bubble", ["bubble"])]
FOCI = [("multicomponent", ["multicomponent", "hea", "high entropy", "mpea"]), ("solder", ["solder", "snagcu", "sac"]), ("superalloy", ["superalloy", "inconel", "in718"]), ("power", ["power", "watt", "w "]), ("scan_speed", ["scan speed", "scanning speed"]), ("method", ["method", "technique", "process"]), ("property", ["property", "thermal conductivity", "hardness", "grain size"])]
# Section headings and the chunk size and overlap of each section.
SECTION_HEADINGS = [("ABSTRACT", r"\n\s*Abstract\s*\n"), ("INTRODUCTION", r"\n\s*1\.\s*Introduction\s*\n"), ("METHODS", r"\n\s*(?:2\.)?\s*Experimental\s*(?:Setup|Methods|Details)?\s*\n"), ("RESULTS", r"\n\s*(?:3\.)?\s*Results\s*(?:and\s*Discussion)?\s*\n"), ("DISCUSSION", r"\n\s*(?:4\.)?\s*Discussion\s*\n"), ("CONCLUSION", r"\n\s*Conclusion")]
SECTION_SIZES = {"ABSTRACT": (400, 50), "CONCLUSION": (400, 50), "METHODS": (600, 100)}
# Laser parameters of a chunk.
CHUNK_PARAMETERS = {
    "wavelength_nm": r"([0-9]+(?:\.[0-9]+)?)\s*(?:nm|nanometers?)\s*(?:wavelength|λ|lambda)", "pulse_duration_fs": r"([0-9]+(?:\.[0-9]+)?)\s*(?:fs|femtoseconds?)\s*(?:pulse|duration)", "fluence_Jcm2": r"([0-9]+(?:\.[0-9]+)?)\s*(?:J/cm²|J/cm2|fluence)",
    "repetition_rate": r"([0-9]+(?:\.[0-9]+)?)\s*(?:kHz|MHz|Hz)\s*(?:repetition|rate|freq)", "spot_size_um": r"([0-9]+(?:\.[0-9]+)?)\s*(?:µm|um|microns?)\s*(?:spot|diameter)",
}
# Numbers with a unit.
NUMBER_UNIT = r"([0-9]+(?:\.[0-9]+)?(?:\s*[×x]\s*10\^?\(?[-+]?[0-9]+\)?)?)\s*(W|watts?|mW|kW|MW|mm/s|mm/min|m/s|J/cm²|J/cm2|mJ/cm²|µJ/cm²|nm|µm|um|microns?|mm|cm|fs|ps|ns|μs|microseconds?|ms|kHz|MHz|Hz|µJ|uJ|mJ|nJ|J|%|percent|K|°C|°F|GPa|MPa|Pa|g/cm³|kg/m³)"
# Claims of units in five groups.
CLAIM_UNITS = {"energy": r"([0-9]+(?:\.[0-9]+)?)\s*(?:J/mm³|J/mm3)", "temperature": r"([0-9]+(?:\.[0-9]+)?)\s*(?:K|°C|°F)", "strength": r"([0-9]+(?:\.[0-9]+)?)\s*(?:HV|Vickers|GPa|MPa)", "diffusivity": r"([0-9]+(?:\.[0-9]+)?)\s*(?:m²/s|cm²/s|m2/s)", "length": r"([0-9]+(?:\.[0-9]+)?)\s*(?:μm|µm|um|nm|mm)"}
#: Templates of claims: predicate and pattern of subject and object.
CLAIMS = {
    "has_threshold": r"(?i:ablation threshold|threshold fluence) (?:of|for) ([a-z ]+?) (?:is|was|were|are|about) ([0-9]+\.?[0-9]* ?[A-Za-z/²]+)", "exhibits_morphology": r"([a-z ]+?) (?:exhibits|shows|displays|forms|produces) ([a-z ]+?(?:ripples|structures|morphology|texture|image))",
    "has_periodicity": r"(?i:periodicity|period|spacing) (?:of|for) ([a-z ]+?) (?:is|was) ([0-9]+\.?[0-9]* ?(?:nm|µm|um))", "has_roughness": r"(?i:roughness|Ra) (?:of|for) ([a-z ]+?) (?:is|was) ([0-9]+\.?[0-9]* ?(?:nm|µm|um))",
    "influences": r"(?:The|the) ([a-z]+ [a-z]+) (?:reduces|increases|controls|governs|limits) (?:the |every )?([a-z]+ [a-z]+)",
}
#: Ordered guesses of a quantity from the context of an unknown unit.
GUESSES = [("youngs_modulus", ["modulus", "young"]), ("viscosity", ["viscos"]), ("enthalpy", ["enthalp", "latent"]), ("gibbs_free_energy", ["gibbs"]), ("energy_density", ["energy density", "volumetric"]), ("hardness", ["hardness", "vickers", "rockwell"]), ("cooling_rate", ["cooling", "solidification"])]
#: Quantities with the words that speak for and against them.
ONTOLOGY = {
    "laser_power": (["w", "watt"], ["power", "laser"], ["speed", "energy density"], (0.001, 100000.0)), "scan_speed": (["mm/s", "m/s"], ["scan", "speed", "velocity"], ["cooling"], (0.01, 10000.0)), "fluence": (["j/cm"], ["fluence", "threshold"], ["volumetric"], (0.0001, 1000.0)),
    "yield_strength": (["mpa", "gpa"], ["yield", "strength"], ["pressure", "modulus"], (10.0, 5000.0)), "temperature": (["k", "°c"], ["temperature", "heated"], ["conductivity"], (0.0, 10000.0)), "grain_size": (["µm", "um", "nm"], ["grain"], ["wavelength", "spot"], (0.001, 10000.0)),
    "wavelength": (["nm"], ["wavelength"], ["grain", "roughness"], (100.0, 11000.0)), "porosity": (["%"], ["porosity", "pore", "void"], ["humidity"], (0.0, 100.0)),
}
#: Words of texts that deserve a better summary.
TIER_BOOSTERS, TIER2_WORDS, TIER1_WORDS = ["governing equation", "constitutive", "conclusion"], ["mechanism", "model", "equation", "strength", "simulation", "transformation"], ["measured", "sample", "reported", "recorded", "observed", "ratio"]
#: Variants of units by which a query prefers one.
UNIT_VARIANTS = {"W": ["watt", " w ", "kw", "power"], "mm/s": ["mm/s", "speed"], "MPa": ["mpa", "gpa", "strength", "stress"], "K": ["kelvin", "temperature", "°c"], "µm": ["µm", "um", "micron", "grain size"], "nm": ["nm", "nanometer", "wavelength"], "%": ["%", "percent", "porosity"], "kHz": ["khz", "mhz", "repetition"]}
COMMON_UNITS = ["MPa", "GPa", "kPa", "Pa", "N/m²", "N/mm²", "J/cm³", "J/mm³", "J/mm3", "MJ/m³", "kJ/mol", "J/mol", "J/g", "W/m·K", "W/mK", "Pa·s", "mPa·s", "cP", "K/s", "°C/s", "K/min", "HV", "HRC", "HB", "m/s", "mm/s", "µm/s", "g/cm³", "kg/m³", "wt.%", "at.%", "vol.%"]
SECTIONS = ["abstract", "introduction", "method", "result", "discussion", "conclusion"]
#: Words of a summary, of keyword searches and of phrases.
SUMMARY_WORDS = ["laser", "scan", "hatch", "powder"]
DEFECT_WORDS = ["pore", "porosity", "crack", "keyhole", "lack of fusion"]
# Symbols of the elements.
ELEMENTS = "H He Li Be B C N O F Ne Na Mg Al Si P S Cl Ar K Ca Sc Ti V Cr Mn Fe Co Ni Cu Zn Ga Ge As Se Br Kr Rb Sr Y Zr Nb Mo Tc Ru Rh Pd Ag Cd In Sn Sb Te I Xe Cs Ba La Ce Pr Nd Pm Sm Eu Gd Tb Dy Ho Er Tm Yb Lu Hf Ta W Re Os Ir Pt Au Hg Tl Pb Bi Po At Rn Fr Ra Ac Th Pa U Np Pu Am Cm Bk Cf Es Fm Md No Lr Rf Db Sg Bh Hs Mt Ds Rg Cn Nh Fl Mc Lv Ts Og".split()
