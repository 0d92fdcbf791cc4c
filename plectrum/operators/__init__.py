"""plectrum.operators"""
