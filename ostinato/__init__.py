"""Rhythm analytics for many-well, many-feature time series on Spark."""

from .operators.cosinor import CosinorDetection
from .operators.damped import DampedCosinorDetection
from .operators.dct import dct_spectrum
from .operators.jtk import EmpiricalJTK, JTKCycle
from .operators.plots import CosinorFrames, JTKFrames
from .operators.wavelet import WaveletAnalyzer
from .plans.dct import dct_periods, dct_process_file
from .plans.detect import detect, detect_cosinor_multiperiod
from .plans.network import NetworkAnalyzer
from .plans.preprocess import preprocess_aggregation, preprocess_to_clean_signal
from .sources.results import OscillationResults

__all__ = [
    "CosinorDetection",
    "CosinorFrames",
    "DampedCosinorDetection",
    "EmpiricalJTK",
    "JTKCycle",
    "JTKFrames",
    "NetworkAnalyzer",
    "OscillationResults",
    "WaveletAnalyzer",
    "dct_periods",
    "dct_process_file",
    "dct_spectrum",
    "detect",
    "detect_cosinor_multiperiod",
    "preprocess_aggregation",
    "preprocess_to_clean_signal",
]
