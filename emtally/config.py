"""Options of an estimation."""

from dataclasses import asdict, dataclass

from emtally.functions.libtype import AUTO, parse_option, serialised


@dataclass(frozen=True)
class QuantOptions:
    """``lib_type``: a library type's name or AUTO. fld_mean and fld_sd are needed for unpaired input, each with the
    other. Bootstraps and Gibbs samples exclude each other. One factorization bin means basic classes."""

    input: str = ""
    lib_type: str = "IU"
    output: str = ""
    max_iter: int = 1500
    convergence_thresh: float = 1e-3
    presence_thresh: float = 1e-8
    param_est_frags: int = 500_000
    fld_mean: float | None = None
    fld_sd: float | None = None
    num_bootstraps: int = 0
    num_gibbs_samples: int = 0
    gibbs_thinning_factor: int = 5
    factorized_eqc_bins: int = 64
    num_threads: int = 16
    auto_detect_samples: int = 10_000

    def __post_init__(self):
        object.__setattr__(self, "lib_type", parse_option(self.lib_type))
        if (self.fld_mean is None) != (self.fld_sd is None):
            raise ValueError("fld_mean and fld_sd need each other")
        if self.num_bootstraps and self.num_gibbs_samples:
            raise ValueError("bootstraps and Gibbs samples can't both be drawn")
        if self.factorized_eqc_bins < 1:
            raise ValueError("at least one factorization bin is needed")

    def as_dict(self) -> dict:
        return asdict(self) | {"lib_type": "Auto" if self.lib_type == AUTO else serialised(self.lib_type)}
