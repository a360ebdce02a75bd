"""Migrations of a whole profile as one matrix: what the operators by columns are held against."""

import numpy as np

from firnlight.operators.migration import GRAZING, edge_taper


def stolt_matrix(data: np.ndarray, dt: float, spacing: float, velocity: float, across: int = 10, down: int = 10) -> np.ndarray:
    """Stolt's mapping of frequency to vertical wavenumber at a constant velocity."""
    n, m = data.shape
    x = data * edge_taper(m, across)[None, :] * edge_taper(n, down)[:, None]
    spec = np.fft.fft2(x)
    omega = 2 * np.pi * np.fft.fftfreq(n, dt)
    kx = 2 * np.pi * np.fft.fftfreq(m, spacing)
    kz = omega * 2 / velocity
    order = np.argsort(omega)
    out = np.zeros_like(spec)
    for j in range(m):
        wanted = np.sign(kz) * velocity / 2 * np.sqrt(kz**2 + kx[j] ** 2)
        column = spec[order, j]
        value = np.interp(wanted, omega[order], column.real, 0, 0) + 1j * np.interp(wanted, omega[order], column.imag, 0, 0)
        root = np.sqrt(kx[j] ** 2 + kz**2)
        out[:, j] = value * np.divide(np.abs(kz), root, out=np.zeros(n), where=root > 0)
    out[0, 0] = 0
    return np.fft.ifft2(out).real


def phase_shift_matrix(data: np.ndarray, dt: float, spacing: float, velocity, across: int = 10, down: int = 10) -> np.ndarray:
    """Gazdag's phase shift; ``velocity`` constant or one value per output time."""
    n, m = data.shape
    speed = np.broadcast_to(np.asarray(velocity, float), (n,))
    x = data * edge_taper(m, across)[None, :] * edge_taper(n, down)[:, None]
    size = 1 << (2 * n - 1).bit_length()
    spec = np.fft.fft2(x, (size, m))
    omega = 2 * np.pi * np.fft.fftfreq(size, dt)[:, None]
    kx = 2 * np.pi * np.fft.fftfreq(m, spacing)[None, :]
    image = np.zeros((n, m), complex)
    phase = np.ones_like(spec)
    for i in range(n):
        image[i] = (spec * phase).sum(0) / size
        with np.errstate(divide="ignore", invalid="ignore"):
            cos2 = 1 - (speed[i] * kx / (2 * omega)) ** 2
        inside = np.isfinite(cos2) & (cos2 > GRAZING)
        phase = np.where(inside, phase * np.exp(1j * omega * dt * np.sqrt(np.where(inside, cos2, 0))), 0)
    return np.fft.ifft(image, axis=1).real


def lateral_matrix(data: np.ndarray, dt: float, spacing: float, velocity: np.ndarray, across: int = 10, down: int = 10) -> np.ndarray:
    """Fourier finite differences, frequency by frequency, with dense systems; ``velocity`` as (samples x traces)."""
    n, m = data.shape
    x = data * edge_taper(m, across)[None, :] * edge_taper(n, down)[:, None]
    size = 1 << (2 * n - 1).bit_length()
    spec = np.fft.fft(x, size, axis=0)
    kx = 2 * np.pi * np.fft.fftfreq(m, spacing)
    second = np.diag(np.full(m, -2.0)) + np.diag(np.ones(m - 1), 1) + np.diag(np.ones(m - 1), -1)
    image = np.zeros((n, m))
    for w, field in zip(2 * np.pi * np.fft.fftfreq(size, dt), spec):
        for i in range(n):
            image[i] += field.real / size
            if w == 0:
                break
            c = velocity[i].min()
            p = c / velocity[i]
            cos2 = 1 - (c * kx / (2 * w)) ** 2
            field = np.fft.ifft(np.fft.fft(field) * np.where(cos2 > GRAZING, np.exp(1j * w * dt * np.sqrt(np.maximum(cos2, 0))), 0)) * np.exp(1j * w * dt * (p - 1))
            kappa = (velocity[i] / (2 * w * spacing)) ** 2
            real, turned = np.minimum((1 + p + p**2) / 4 * kappa, 0.25), w * dt * p * (1 - p) * kappa / 4
            field = np.linalg.solve(np.eye(m) + (real - 1j * turned)[:, None] * second, field + (real + 1j * turned) * (second @ field))
    return image
