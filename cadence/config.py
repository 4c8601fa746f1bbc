"""Constants that carry meaning for the metrics, as overridable defaults.

Every operator takes these as arguments; nothing below is hard-coded inside an
operator. ``Defaults`` is frozen so one instance can be shared safely. Who the
bots and the team are, the organisation and the markers of its shared pipelines
and modules belong to the caller; the values here are neutral stand-ins.
"""

from __future__ import annotations

from dataclasses import dataclass, replace

# --- stand-ins, to be given by the caller ---
BOT_AUTHORS: tuple[str, ...] = ("dependabot",)
TEAM_MEMBERS: tuple[str, ...] = ()
DX_PIPELINE_MARKER = "acme/dx"
DX_MODULE_MARKERS = ("acme-dx", "acme/dx")
CODE_SEARCH_QUERY = "acme/dx org:acme"
ORGANIZATION = "acme"
DX_REPO = "dx"
# --- fixed values (must equal the original dashboards for equal results) ---
EXCLUDED_WORKFLOWS = ("CodeQL", "Labeler")
LABELER_WORKFLOW = "Labeler"
DEPLOY_WORDS = ("deploy", "delivery", "release", "apply")
EXCLUDED_TITLE = "Version Packages"
GRAIN_SWITCH_DAYS = 240
DEFAULT_DAYS = 120
SIZE_EDGES = (50, 200, 500, 1000)
SIZE_LABELS = ("0-50", "51-200", "201-500", "501-1000", "1000+")
DX_PIPELINE_LABEL = "DX Pipelines"
NON_DX_PIPELINE_LABEL = "Non-DX Pipelines"
DX_MODULE_LABEL = "DX Terraform Modules"
NON_DX_MODULE_LABEL = "Non-DX Terraform Modules"
DX_LIST_LABEL = "✓ DX"
NON_DX_LIST_LABEL = "Non-DX"
SUPERVISED_LABEL = "Supervised PRs"
UNSUPERVISED_LABEL = "Unsupervised PRs"
OWN_REPO_PATTERN = "(dx|eng)"
EXCLUDED_REPO_SUBSTRING = "technology-radar"
ADOPTION_EXCLUDED_SUBSTRING = "dx"
INFRA_PLAN_FILE = "infra_plan.yaml"
INFRA_APPLY_FILE = "infra_apply.yaml"
# --- end of fixed values ---


@dataclass(frozen=True)
class Defaults:
    """Arguments shared by the metrics; override with ``dataclasses.replace``."""

    bots: tuple[str, ...] = BOT_AUTHORS
    team: tuple[str, ...] = TEAM_MEMBERS
    dx_pipeline_marker: str = DX_PIPELINE_MARKER
    dx_module_markers: tuple[str, ...] = DX_MODULE_MARKERS
    excluded_workflows: tuple[str, ...] = EXCLUDED_WORKFLOWS
    labeler_workflow: str = LABELER_WORKFLOW
    deploy_words: tuple[str, ...] = DEPLOY_WORDS
    excluded_title: str = EXCLUDED_TITLE
    grain_switch_days: int = GRAIN_SWITCH_DAYS
    days: int = DEFAULT_DAYS
    size_edges: tuple[int, ...] = SIZE_EDGES
    size_labels: tuple[str, ...] = SIZE_LABELS
    own_repo_pattern: str = OWN_REPO_PATTERN
    excluded_repo_substring: str = EXCLUDED_REPO_SUBSTRING
    code_search_query: str = CODE_SEARCH_QUERY
    adoption_excluded_substring: str = ADOPTION_EXCLUDED_SUBSTRING
    organization: str = ORGANIZATION
    dx_repo: str = DX_REPO
    infra_plan_file: str = INFRA_PLAN_FILE
    infra_apply_file: str = INFRA_APPLY_FILE
    dx_pipeline_label: str = DX_PIPELINE_LABEL
    non_dx_pipeline_label: str = NON_DX_PIPELINE_LABEL

    def with_(self, **kw) -> "Defaults":
        return replace(self, **kw)


DEFAULTS = Defaults()
