"""creditspark.ml"""
