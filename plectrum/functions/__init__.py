"""plectrum.functions"""
