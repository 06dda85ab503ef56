"""The vocabulary of the clinical tables. These must be as they are for results
to mean the same; everything else in the package is independent of them."""

from __future__ import annotations

# Dialysis labs, in table order.
DIALYSIS_LABS = (
    "Cl", "CO2CP", "WBC", "Hb", "Urea", "Ca", "K", "Na", "Scr", "P", "Albumin", "hs-CRP",
    "Glucose", "Appetite", "Weight", "SBP", "DBP",
)

# Display names of the dialysis labs.
DISPLAY_NAMES = {
    "Cl": "Blood chlorine",
    "CO2CP": "Carbon dioxide binding power",
    "WBC": "White blood cells",
    "Hb": "Hemoglobin",
    "Urea": "Urea",
    "Ca": "Blood calcium",
    "K": "Blood potassium",
    "Na": "Blood sodium",
    "Scr": "Creatinine",
    "P": "Blood phosphorus",
    "Albumin": "Albumin",
    "hs-CRP": "Hypersensitive C reactive protein",
    "Glucose": "Blood glucose",
    "Appetite": "Food intake (with water)",
    "Weight": "Weight",
    "SBP": "Systolic blood pressure",
    "DBP": "Diastolic blood pressure",
}

# Units of the dialysis labs.
UNITS = {
    "Cl": "mmol/L",
    "CO2CP": "mmol/L",
    "WBC": "×10^9/L",
    "Hb": "g/L",
    "Urea": "mmol/L",
    "Ca": "mmol/L",
    "K": "mmol/L",
    "Na": "mmol/L",
    "Scr": "μmol/L",
    "P": "mmol/L",
    "Albumin": "g/L",
    "hs-CRP": "mg/L",
    "Glucose": "mmol/L",
    "Appetite": "g",
    "Weight": "kg",
    "SBP": "mmHg",
    "DBP": "mmHg",
}

# Reference range (low, high) for healthy people.
HEALTHY_RANGES = {
    "Cl": (96, 106),
    "CO2CP": (20, 29),
    "WBC": (3.5, 9.5),
    "Hb": (115, 150),
    "Urea": (3.1, 8.0),
    "Ca": (2.25, 2.75),
    "K": (3.5, 5.5),
    "Na": (135, 145),
    "Scr": (62, 115),
    "P": (1.1, 1.3),
    "Albumin": (40, 55),
    "hs-CRP": (0.5, 10),
    "Glucose": (3.9, 6.1),
    "SBP": (100, 120),
    "DBP": (60, 80),
}

# Reference range in words for dialysis patients.
DIALYSIS_RANGES = {
    "Cl": "higher than 96 mmol/L",
    "CO2CP": "higher than 25 mmol/L",
    "Hb": "higher than 114 g/L",
    "Urea": "higher than 20 mmol/L",
    "Ca": "higher than 2.5 mmol/L",
    "K": "higher than 4 mmol/L",
    "Na": "higher than 135.5 mmol/L",
    "Scr": "higher than 900 μmol/L",
    "P": "higher than 1.5 mmol/L",
    "Albumin": "higher than 32 g/L",
    "hs-CRP": "lower than 16 mg/L",
    "Glucose": "lower than 6 mmol/L",
    "Weight": "higher than 59 kg",
    "SBP": "higher than 130 mmHg",
    "DBP": "higher than 70 mmHg",
}

# Comorbidity flag columns and their names.
COMORBIDITIES = {
    "Diabetes": "Diabetes",
    "Heart_failure": "Heart failure",
    "Lung_infect": "Lung infection",
    "CHD": "Coronary heart disease",
    "MI": "Myocardial infarction",
    "CI": "Cerebral infarction",
    "CH": "Cerebral hemorrhage",
    "Amputation": "Amputation",
}

# First token of the original-disease field and its English name.
ORIGINAL_DISEASES = {
    "慢性肾小球肾炎": "Chronic glomerulonephritis",
    "慢性肾小球性肾炎": "Chronic glomerulonephritis",
    "不明": "unspecified",
    "糖尿病肾病": "Diabetic Nephropathy",
    "高血压肾损害": "Hypertensive kidney damage",
    "慢性肾盂肾炎": "Chronic pyelonephritis",
    "良性动脉硬化": "Benign arteriosclerosis",
    "慢性间质性肾炎": "Chronic interstitial nephritis",
    "常染色体显性多囊肾病": "Autosomal dominant polycystic kidney disease",
    "梗阻性肾病": "Obstructive nephropathy",
    "原发性小血管炎肾损害": "Primary small vessel vasculitis renal damage",
    "高血压肾病": "Hypertensive nephropathy",
    "肾动脉硬化": "Renal arteriosclerosis",
    "缺血性肾病": "Ischemic nephropathy",
    "多发性骨髓瘤肾损害": "Renal damage in multiple myeloma",
    "多囊肾": "Polycystic kidney",
    "肾移植后肾炎": "Post-transplant nephritis",
    "系统性红斑狼疮性肾炎": "Systemic lupus erythematosus nephritis",
    "包虫病": "Inclusion disease",
    "淀粉样变性肾病": "Amyloidosis nephropathy",
    "痛风慢性间质性肾炎": "Gout chronic interstitial nephritis",
    "未知": "unknown",
    "null": "null",
    "其他": "Other",
    "过敏性紫癜性肾炎": "Allergic purpura nephritis",
    "DN": "DN",
    "IGA肾病": "IGA nephropathy",
    "局灶增生性肾小球肾炎伴肾小管间质": "Focal proliferative glomerulonephritis with tubulointerstitial",
    "肾病综合症伴膜性增殖性IGA肾病": "tubulointerstitial Nephrotic syndrome with membranoproliferative IGA nephropathy ",
    "肾炎": "nephritis",
    "高血压肾损害肾小球肾炎?": "Hypertensive renal damage glomerulonephritis?",
    "心肾综合征": "Cardiorenal syndrome",
    "糖尿病肾病心衰": "Diabetic nephropathy heart failure",
}

# Intensive-care labs, in table order; the first five are categorical.
ICU_CATEGORICAL_LABS = (
    "Capillary refill rate",
    "Glascow coma scale eye opening",
    "Glascow coma scale motor response",
    "Glascow coma scale total",
    "Glascow coma scale verbal response",
)
ICU_NUMERIC_LABS = (
    "Diastolic blood pressure",
    "Fraction inspired oxygen",
    "Glucose",
    "Heart Rate",
    "Height",
    "Mean blood pressure",
    "Oxygen saturation",
    "Respiratory rate",
    "Systolic blood pressure",
    "Temperature",
    "Weight",
    "pH",
)

# Reference ranges in words and units of the intensive-care labs.
ICU_RANGES = {
    "Diastolic blood pressure": "less than 80 mmHg",
    "Fraction inspired oxygen": "more than 0.21",
    "Glucose": "70 mg/dL - 100 mg/dL",
    "Heart Rate": "60 bpm - 100 bpm",
    "Mean blood pressure": "less than 100 mmHg",
    "Oxygen saturation": "95 % - 100 %",
    "Respiratory rate": "15 breaths per minute - 18 breaths per minute",
    "Systolic blood pressure": "less than 120 mmHg",
    "Temperature": "36.1 degrees Celsius - 37.2 degrees Celsius",
    "pH": "7.35 - 7.45",
}
ICU_UNITS = {
    "Diastolic blood pressure": "mmHg",
    "Glucose": "mg/dL",
    "Heart Rate": "bpm",
    "Height": "cm",
    "Mean blood pressure": "mmHg",
    "Oxygen saturation": "%",
    "Respiratory rate": "breaths per minute",
    "Systolic blood pressure": "mmHg",
    "Temperature": "degrees Celsius",
    "Weight": "kg",
}

# COVID labs, in table order and as spelt in the tables (blanks and signs count).
COVID_LABS = (
    "MAX_BLOOD_PRESSURE",
    "MIN_BLOOD_PRESSURE",
    "TEMPERATURE",
    "HEART_RATE",
    "OXYGEN_SATURATION",
    "ADW -- Coeficiente de anisocitosis",
    "ADW -- SISTEMATICO DE SANGRE",
    "ALB -- ALBUMINA",
    "AMI -- AMILASA",
    "AP -- ACTIVIDAD DE PROTROMBINA",
    "APTT -- TIEMPO DE CEFALINA (APTT)",
    "AU -- ACIDO URICO",
    "BAS -- Bas¢filos",
    "BAS -- SISTEMATICO DE SANGRE",
    "BAS% -- Bas¢filos %",
    "BAS% -- SISTEMATICO DE SANGRE",
    "BD -- BILIRRUBINA DIRECTA",
    "BE(b) -- BE(b)",
    "BE(b)V -- BE (b)",
    "BEecf -- BEecf",
    "BEecfV -- BEecf",
    "BT -- BILIRRUBINA TOTAL",
    "BT -- BILIRRUBINA TOTAL                                                               ",
    "CA -- CALCIO                                                                          ",
    "CA++ -- Ca++ Gasometria",
    "CHCM -- Conc. Hemoglobina Corpuscular Media",
    "CHCM -- SISTEMATICO DE SANGRE",
    "CK -- CK (CREATINQUINASA)",
    "CL -- CLORO",
    "CREA -- CREATININA",
    "DD -- DIMERO D",
    "EOS -- Eosin¢filos",
    "EOS -- SISTEMATICO DE SANGRE",
    "EOS% -- Eosin¢filos %",
    "EOS% -- SISTEMATICO DE SANGRE",
    "FA -- FOSFATASA ALCALINA",
    "FER -- FERRITINA",
    "FIB -- FIBRINàGENO",
    "FOS -- FOSFORO",
    "G-CORONAV (RT-PCR) -- Tipo de muestra: Exudado Far¡ngeo/Nasofar¡ngeo",
    "GGT -- GGT (GAMMA GLUTAMIL TRANSPEPTIDASA)",
    "GLU -- GLUCOSA",
    "GOT -- GOT (AST)",
    "GPT -- GPT (ALT)",
    "HCM -- Hemoglobina Corpuscular Media",
    "HCM -- SISTEMATICO DE SANGRE",
    "HCO3 -- HCO3-",
    "HCO3V -- HCO3-",
    "HCTO -- Hematocrito",
    "HCTO -- SISTEMATICO DE SANGRE",
    "HEM -- Hemat¡es",
    "HEM -- SISTEMATICO DE SANGRE",
    "HGB -- Hemoglobina",
    "HGB -- SISTEMATICO DE SANGRE",
    "INR -- INR",
    "K -- POTASIO",
    "LAC -- LACTATO",
    "LDH -- LDH",
    "LEUC -- Leucocitos",
    "LEUC -- SISTEMATICO DE SANGRE",
    "LIN -- Linfocitos",
    "LIN -- SISTEMATICO DE SANGRE",
    "LIN% -- Linfocitos %",
    "LIN% -- SISTEMATICO DE SANGRE",
    "MG -- MAGNESIO",
    "MONO -- Monocitos",
    "MONO -- SISTEMATICO DE SANGRE",
    "MONO% -- Monocitos %",
    "MONO% -- SISTEMATICO DE SANGRE",
    "NA -- SODIO",
    "NEU -- Neutr¢filos",
    "NEU -- SISTEMATICO DE SANGRE",
    "NEU% -- Neutr¢filos %",
    "NEU% -- SISTEMATICO DE SANGRE",
    "PCO2 -- pCO2",
    "PCO2V -- pCO2",
    "PCR -- PROTEINA C REACTIVA",
    "PH -- pH",
    "PHV -- pH",
    "PLAQ -- Recuento de plaquetas",
    "PLAQ -- SISTEMATICO DE SANGRE",
    "PO2 -- pO2",
    "PO2V -- pO2",
    "PROCAL -- PROCALCITONINA",
    "PT -- PROTEINAS TOTALES",
    "SO2C -- sO2c (Saturaci¢n de ox¡geno)",
    "SO2CV -- sO2c (Saturaci¢n de ox¡geno)",
    "TCO2 -- tCO2(B)c",
    "TCO2V -- tCO2 (B)",
    "TP -- TIEMPO DE PROTROMBINA",
    "TROPO -- TROPONINA",
    "U -- UREA",
    "VCM -- SISTEMATICO DE SANGRE",
    "VCM -- Volumen Corpuscular Medio",
    "VPM -- SISTEMATICO DE SANGRE",
    "VPM -- Volumen plaquetar medio",
    "VSG -- VSG",
)

# Words and bounds of the descriptions.
RISK_LEVELS = ((0.5, "a low level"), (0.7, "a high level"))
TOP_RISK = "an extremely high level"
RANK_BANDS = ((40, "at the bottom 40% levels"), (70, "at the middle 30% levels"))
TOP_BAND = "at the top 30% levels"
BELOW_RANGE = "the value is lower than normal range by %s%%"
ABOVE_RANGE = "the value is higher than normal range by %s%%"
WITHIN_RANGE = "the value is within the normal range"
NOTE_CHARACTERS = 1024
STATEMENT_HEADER = "Doctor %d's statement is as following:\n"
