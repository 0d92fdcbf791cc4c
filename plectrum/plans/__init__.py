"""plectrum.plans"""
