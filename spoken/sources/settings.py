"""Settings of the speech plan: defaults, files that change them, and what is wrong with them."""

from __future__ import annotations

import json
from dataclasses import dataclass, fields, replace
from pathlib import Path

# --- fixed values: stress marks that a voice model wants; languages of the models beside the Russian one ----------------------------------
MODEL_STRESS = {"v5_5_ru": "auto", "v5_5_ru_manual": "manual", "v5_4_ru": "auto", "v5_3_ru": "auto", "v5_2_ru": "auto", "v5_1_ru": "auto", "v5_ru": "auto", "v5_cis_base": "manual", "v5_cis_base_nostress": "manual", "v5_cis_ext": "manual", "v4_ru": "manual", "ru_v3": "manual", "v3_1_ru": "manual"}
MODEL_LANGUAGE = {"v3_en": "en", "v3_de": "de", "v3_fr": "fr", "v3_es": "es", "v3_en_indic": "en"}
SAMPLE_RATES = (8000, 16000, 24000, 48000)


@dataclass(frozen=True)
class Settings:
    """Every value that changes the plan. Pauses are seconds."""

    ru_model: str = "v5_cis_base_nostress"
    en_model: str = "v3_en"
    ru_speaker: str | None = None
    en_speaker: str = "en_0"
    service_speaker: str | None = None
    emphasis_speaker: str | None = None
    sample_rate: int = 48000
    speed: float = 1.0
    pause_between_paragraphs: float = 0.2
    pause_between_sentences: float = 0.05
    pause_comma: float = 0.05
    pause_dash: float = 0.2
    pause_semicolon: float = 0.1
    pause_colon: float = 0.12
    pause_between_chapters: float = 1.5
    pause_between_subsections: float = 0.8
    force_punctuation: bool = False
    ssml_enabled: bool = False
    footnote_prefix: str = "Сноска"
    footnote_suffix: str = "Конец сноски"
    annotation_prefix: str = "Аннотация"
    annotation_suffix: str = "Конец аннотации"
    final_phrase: str = "Конец озвученного текста."
    skip_footnotes: bool = False
    footnote_pause_before: float = 0.3
    footnote_pause_after: float = 0.3
    footnote_force_comma: bool = True
    loudness_target: float | None = -23.0
    max_chunk_length: int = 900
    blocks_per_part: int = 100
    emphasis_as_text: bool = False
    emphasis_pause_before: float = 0.0
    emphasis_pause_after: float = 0.0
    emphasis_speed: float = 1.0
    emphasis_pitch: str = "medium"
    en_pause_before: float = 0.0
    en_pause_after: float = 0.0

    @property
    def pauses(self) -> dict[str, float]:
        return {"sentence": self.pause_between_sentences, "semicolon": self.pause_semicolon, "colon": self.pause_colon, "comma": self.pause_comma, "dash": self.pause_dash, "paragraph": self.pause_between_paragraphs, "chapter": self.pause_between_chapters}

    @property
    def stress(self) -> str:
        """How the Russian model wants stress: ``auto`` or ``manual``."""
        return MODEL_STRESS.get(self.ru_model, "auto")

    @property
    def foreign(self) -> str:
        """Language of the model beside the Russian one."""
        return MODEL_LANGUAGE.get(self.en_model, "en")

    def problems(self) -> list[str]:
        """What is out of range; empty if all is well."""
        wrong = [
            (self.speed <= 0, "speed must be above 0"), (self.speed > 4, "speed must be at most 4"),
            (self.max_chunk_length < 100, "max_chunk_length must be at least 100"), (self.max_chunk_length > 2000, "max_chunk_length must be at most 2000"),
            (self.sample_rate not in SAMPLE_RATES, f"sample_rate must be one of {SAMPLE_RATES}"),
            (self.loudness_target is not None and self.loudness_target > 0, "loudness_target must not be above 0"),
            (self.loudness_target is not None and self.loudness_target < -70, "loudness_target must be at least -70"),
            (self.blocks_per_part < 1, "blocks_per_part must be at least 1"),
        ]
        return [text for bad, text in wrong if bad]

    def voice(self, use: str, speakers: dict[str, list[str]] | None = None) -> str:
        """The voice for a language, for ``service`` or for ``emphasis``. ``speakers``: those of each language that are there. Models for
        several languages name their Russian voices ``ru_...``."""
        if use == "service" and self.service_speaker:
            return self.service_speaker
        if use == "emphasis" and self.emphasis_speaker:
            return self.emphasis_speaker
        if use not in ("ru", "service", "emphasis"):
            if use == self.foreign and speakers is None:
                return self.en_speaker
            return next(iter((speakers or {}).get(use, [])), f"{use}_0")
        if self.ru_speaker:
            return self.ru_speaker
        several, own = "cis" in self.ru_model, (speakers or {}).get("ru", [])
        if not own:
            return "ru_dmitriy" if several else "kseniya"
        return next((s for s in own if several and s.startswith("ru_")), own[0])


DEFAULTS = Settings()


def clamped(settings: Settings) -> Settings:
    """Speed brought into 0.25 to 4; a speed that is no speed is an error."""
    if settings.speed <= 0:
        raise ValueError("speed must be above 0")
    return replace(settings, speed=min(4.0, max(0.25, settings.speed)))


def load_settings(path: str | None = None, **overrides) -> Settings:
    """Defaults, then a JSON or YAML file, then overrides that are not None. Unknown names and files that cannot be read change nothing."""
    found: dict = {}
    if path and Path(path).exists():
        text = Path(path).read_text(encoding="utf-8")
        try:
            if path.endswith((".yaml", ".yml")):
                import yaml  # optional

                found = yaml.safe_load(text) or {}
            else:
                found = json.loads(text)
        except (ImportError, ValueError) as error:
            if isinstance(error, ImportError):
                found = _plain_yaml(text)
        except Exception as error:  # a YAML error, whose class is in the optional module
            if type(error).__module__.split(".")[0] != "yaml":
                raise
    names = {f.name for f in fields(Settings)}
    chosen = {k: v for k, v in {**(found if isinstance(found, dict) else {}), **{k: v for k, v in overrides.items() if v is not None}}.items() if k in names}
    return replace(DEFAULTS, **chosen)


def _plain_yaml(text: str) -> dict:
    """``key: value`` lines of a flat YAML file, for where the YAML module is missing."""
    out: dict = {}
    for line in text.splitlines():
        key, sign, value = line.partition(":")
        value = value.split(" #")[0].strip()
        if not sign or line.lstrip().startswith("#") or not value or key != key.strip():
            continue
        words = {"true": True, "yes": True, "on": True, "false": False, "no": False, "off": False, "null": None, "~": None}
        try:
            out[key] = words[value.lower()] if value.lower() in words else json.loads(value)
        except ValueError:
            out[key] = value.strip("'\"")
    return out
