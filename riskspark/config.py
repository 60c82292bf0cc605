"""Column roles, code tables and labels that drive every operator.

An operator takes a DataFrame and a ``RiskConfig``; nothing about the student table is wired into the
operators themselves. ``STUDENT`` is the default configuration.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field, replace

N_CLASSES = 3


@dataclass(frozen=True)
class Override:
    """One what-if change: shift a feature by ``delta`` and keep it inside ``[lo, hi]``."""

    feature: str
    delta: float
    lo: float | None = None
    hi: float | None = None


@dataclass(frozen=True)
class RiskConfig:
    id_col: str
    score_col: str
    high_cut: float  # score > high_cut  -> class 2
    low_cut: float  # score >= low_cut -> class 1, below -> class 0
    categories: Mapping[str, Mapping[str, int]]
    encoded_names: Mapping[str, str]
    features: Sequence[str]
    behavioural: Sequence[str]
    labels: Sequence[str]
    display: Mapping[str, str] = field(default_factory=dict)
    first_name: str | None = None
    last_name: str | None = None
    age_col: str | None = None
    segment_col: str | None = None
    weights: Mapping[str, float] = field(default_factory=dict)
    summary_means: Mapping[str, str] = field(default_factory=dict)
    correlation_cols: Sequence[str] = ()
    matrix_cols: Sequence[str] = ()
    describe_cols: Sequence[str] = ()
    count_cols: Sequence[str] = ()
    filter_cols: Sequence[str] = ()
    alert_cols: Sequence[str] = ()
    overrides: Sequence[Override] = ()
    presets: Mapping[str, Mapping[str, object]] = field(default_factory=dict)
    dictionary: Sequence[tuple[str, str, str, str, str]] = ()
    column_types: Mapping[str, str] = field(default_factory=dict)
    main_model: str = "Random Forest"
    label_col: str = "label"
    f1_target: float = 0.75
    export_prefix: str = "alertas_academicas_"

    @property
    def strict_behavioural(self) -> list[str]:
        """Behavioural features that carry no weight in the score itself."""
        return [c for c in self.behavioural if c not in self.weights]

    @property
    def numeric_features(self) -> list[str]:
        encoded = set(self.encoded_names.values())
        return [c for c in self.features if c not in encoded]

    def with_(self, **changes) -> "RiskConfig":
        return replace(self, **changes)


# Column names, category codes, class labels, display names, score weights, cut points,
# form presets and data-dictionary texts are part of the data contract and have to be exactly these.
STUDENT = RiskConfig(
    id_col="Student_ID",
    score_col="Total_Score",
    high_cut=80.0,
    low_cut=60.0,
    first_name="First_Name",
    last_name="Last_Name",
    age_col="Age",
    segment_col="Department",
    label_col="Riesgo_Academico",
    categories={
        "Gender": {"Male": 0, "Female": 1},
        "Department": {"CS": 0, "Engineering": 1, "Mathematics": 2, "Business": 3},
        "Extracurricular_Activities": {"No": 0, "Yes": 1},
        "Internet_Access_at_Home": {"No": 0, "Yes": 1},
        "Parent_Education_Level": {"High School": 0, "Bachelor": 1, "Master": 2, "PhD": 3},
        "Family_Income_Level": {"Low": 0, "Medium": 1, "High": 2},
    },
    encoded_names={
        "Gender": "Gender_enc",
        "Department": "Dept_enc",
        "Extracurricular_Activities": "Extracurr_enc",
        "Internet_Access_at_Home": "Internet_enc",
        "Parent_Education_Level": "ParentEdu_enc",
        "Family_Income_Level": "FamilyInc_enc",
    },
    features=(
        "Attendance (%)", "Midterm_Score", "Final_Score", "Assignments_Avg", "Quizzes_Avg",
        "Participation_Score", "Projects_Score", "Study_Hours_per_Week", "Stress_Level (1-10)",
        "Sleep_Hours_per_Night", "Age", "Gender_enc", "Dept_enc", "Extracurr_enc", "Internet_enc",
        "ParentEdu_enc", "FamilyInc_enc",
    ),
    behavioural=(
        "Attendance (%)", "Study_Hours_per_Week", "Stress_Level (1-10)", "Sleep_Hours_per_Night",
        "Participation_Score", "Extracurr_enc", "Internet_enc", "ParentEdu_enc", "FamilyInc_enc",
        "Age", "Gender_enc", "Dept_enc",
    ),
    labels=("Riesgo Alto", "Riesgo Medio", "Riesgo Bajo"),
    display={
        "Attendance (%)": "Asistencia (%)",
        "Midterm_Score": "Nota Parcial",
        "Final_Score": "Nota Final",
        "Assignments_Avg": "Promedio Tareas",
        "Quizzes_Avg": "Promedio Quizzes",
        "Participation_Score": "Participación",
        "Projects_Score": "Nota Proyectos",
        "Study_Hours_per_Week": "Horas Estudio/Sem",
        "Stress_Level (1-10)": "Nivel Estrés",
        "Sleep_Hours_per_Night": "Horas Sueño",
        "Age": "Edad",
        "Gender_enc": "Género",
        "Dept_enc": "Departamento",
        "Extracurr_enc": "Actividades Extra.",
        "Internet_enc": "Internet en Casa",
        "ParentEdu_enc": "Educación Padres",
        "FamilyInc_enc": "Ingreso Familiar",
    },
    weights={
        "Midterm_Score": 0.15, "Final_Score": 0.25, "Assignments_Avg": 0.15,
        "Quizzes_Avg": 0.10, "Participation_Score": 0.05, "Projects_Score": 0.30,
    },
    summary_means={
        "avg_asistencia": "Attendance (%)",
        "avg_estudio": "Study_Hours_per_Week",
        "avg_estres": "Stress_Level (1-10)",
        "avg_sueno": "Sleep_Hours_per_Night",
    },
    correlation_cols=(
        "Attendance (%)", "Study_Hours_per_Week", "Stress_Level (1-10)",
        "Sleep_Hours_per_Night", "Projects_Score", "Midterm_Score",
    ),
    matrix_cols=(
        "Total_Score", "Attendance (%)", "Study_Hours_per_Week", "Stress_Level (1-10)",
        "Sleep_Hours_per_Night", "Midterm_Score", "Final_Score", "Projects_Score",
        "Assignments_Avg", "Quizzes_Avg",
    ),
    describe_cols=(
        "Total_Score", "Attendance (%)", "Study_Hours_per_Week", "Stress_Level (1-10)",
        "Sleep_Hours_per_Night", "Midterm_Score", "Final_Score", "Projects_Score",
    ),
    count_cols=("Department", "Gender", "Family_Income_Level"),
    filter_cols=("Department", "Gender", "Family_Income_Level"),
    alert_cols=(
        "Student_ID", "First_Name", "Last_Name", "Department", "Age", "Gender", "Attendance (%)",
        "Total_Score", "Study_Hours_per_Week", "Stress_Level (1-10)", "risk_label", "pct_high",
        "confidence",
    ),
    overrides=(
        Override("Study_Hours_per_Week", 5.0, None, 40.0),
        Override("Stress_Level (1-10)", -2.0, 1.0, None),
        Override("Attendance (%)", 10.0, None, 100.0),
        Override("Projects_Score", 10.0, None, 100.0),
    ),
    presets={
        "tipico": {
            "Attendance (%)": 82.0, "Midterm_Score": 70.0, "Final_Score": 68.0,
            "Assignments_Avg": 72.0, "Quizzes_Avg": 65.0, "Participation_Score": 70.0,
            "Projects_Score": 68.0, "Study_Hours_per_Week": 15.0, "Stress_Level (1-10)": 5,
            "Sleep_Hours_per_Night": 7.0, "Age": 20, "Gender": "Male", "Department": "Engineering",
            "Extracurricular_Activities": "Yes", "Internet_Access_at_Home": "Yes",
            "Parent_Education_Level": "Bachelor", "Family_Income_Level": "Medium",
        },
        "riesgo": {
            "Attendance (%)": 55.0, "Midterm_Score": 42.0, "Final_Score": 40.0,
            "Assignments_Avg": 38.0, "Quizzes_Avg": 36.0, "Participation_Score": 28.0,
            "Projects_Score": 33.0, "Study_Hours_per_Week": 4.0, "Stress_Level (1-10)": 9,
            "Sleep_Hours_per_Night": 4.5, "Age": 22, "Gender": "Male", "Department": "Business",
            "Extracurricular_Activities": "No", "Internet_Access_at_Home": "No",
            "Parent_Education_Level": "High School", "Family_Income_Level": "Low",
        },
    },
    dictionary=(
        ("Attendance (%)", "Numérica", "Asistencia del estudiante", "Conductual", "Sí"),
        ("Midterm_Score", "Numérica", "Nota del examen parcial", "Académica ⚠", "Sí (leakage)"),
        ("Final_Score", "Numérica", "Nota del examen final", "Académica ⚠", "Sí (leakage)"),
        ("Assignments_Avg", "Numérica", "Promedio de tareas", "Académica ⚠", "Sí (leakage)"),
        ("Quizzes_Avg", "Numérica", "Promedio de quizzes", "Académica ⚠", "Sí (leakage)"),
        ("Participation_Score", "Numérica", "Puntaje de participación en clase", "Académica ⚠", "Sí (leakage)"),
        ("Projects_Score", "Numérica", "Nota de proyectos", "Académica ⚠", "Sí (leakage)"),
        ("Study_Hours_per_Week", "Numérica", "Horas de estudio por semana", "Conductual", "Sí"),
        ("Stress_Level (1-10)", "Numérica", "Nivel de estrés autoreportado", "Conductual", "Sí"),
        ("Sleep_Hours_per_Night", "Numérica", "Horas de sueño por noche", "Conductual", "Sí"),
        ("Age", "Numérica", "Edad del estudiante", "Sociodemog.", "Sí"),
        ("Gender", "Categórica", "Género (Male/Female)", "Sociodemog.", "Sí (enc.)"),
        ("Department", "Categórica", "Programa académico", "Sociodemog.", "Sí (enc.)"),
        ("Extracurricular_Activities", "Categórica", "Participación extracurricular (Yes/No)", "Conductual", "Sí (enc.)"),
        ("Internet_Access_at_Home", "Categórica", "Acceso a internet en casa (Yes/No)", "Socioeconóm.", "Sí (enc.)"),
        ("Parent_Education_Level", "Categórica", "Nivel educativo del padre/madre", "Socioeconóm.", "Sí (enc.)"),
        ("Family_Income_Level", "Categórica", "Nivel de ingreso familiar (Low/Med/High)", "Socioeconóm.", "Sí (enc.)"),
        ("Total_Score", "Numérica", "Score total (BASE de variable objetivo)", "Objetivo", "No (es la base)"),
    ),
    column_types={
        "Student_ID": "string", "First_Name": "string", "Last_Name": "string",
        "Total_Score": "double", "Attendance (%)": "double", "Midterm_Score": "double",
        "Final_Score": "double", "Assignments_Avg": "double", "Quizzes_Avg": "double",
        "Participation_Score": "double", "Projects_Score": "double",
        "Study_Hours_per_Week": "double", "Stress_Level (1-10)": "int",
        "Sleep_Hours_per_Night": "double", "Age": "int", "Gender": "string",
        "Department": "string", "Extracurricular_Activities": "string",
        "Internet_Access_at_Home": "string", "Parent_Education_Level": "string",
        "Family_Income_Level": "string",
    },
)
