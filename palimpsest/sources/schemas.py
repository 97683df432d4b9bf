"""Declared schemas: the raw observation and the master tables (column names are the data format's, fixed values)."""

from __future__ import annotations

from pyspark.sql import types as T

S, L, D, B = T.StringType(), T.LongType(), T.DoubleType(), T.BooleanType()
NAMES = T.ArrayType(S)


def _struct(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(n, t) for n, t in fields.items()])


LISTING = _struct(
    idOferta=L, nombreCargo=S, nombreEmpresa=S, descripcionOferta=S, nombreJornada=S, fechaPublicacion=S, ubicacion=S, geolocalizacion=S, ofertaDestacada=B, ofertaInclusiva=B
)
DETAIL = _struct(
    estadoOferta=S, idCompany=L, idEmpresa=L, nombreEmpresaFantasia=S, nombreCargo=S, descripcionOferta=S, requisitosMinimos=S, slug=S, ofertaConfidencial=B, mostrarSueldo=B, usaScoreScreening=B,
    fechaPublicacionFormatoIngles=S, fechaExpiracionFormatoIngles=S, nombreTipoCargo=S, nombreArea=S, nombreJornada=S, nombreMoneda=S, nombreNivelAcademico=S, nombreSituacionAcademica=S,
    tipoCurriculumAceptado=S, nombreOperadorExperiencia=S, aniosExperiencia=D, sueldo=D, cantidadVacantes=L, candidadPostulaciones=L, candidadVisualizaciones=L,
    ubicacion=_struct(nombreRegion=S, nombreComuna=S, direccion=S, codigoPostal=S, coordenadas=_struct(type=S, coordinates=T.ArrayType(D))),
    carreras=T.ArrayType(_struct(nombreCarrera=S)), habilidades=T.ArrayType(_struct(nombreHabilidad=S, nombreNivel=S)),
    instituciones=T.ArrayType(_struct(idInstitucion=L, idInstitucionSqlServer=L, nombreInstitucion=S)),
)
OBSERVATION = _struct(aviso_id=L, fecha_scraping=S, periodo=S, area_scraping=S, terminos=NAMES, detalle_ok=B, detalle_motivo=S, listado=LISTING, detalle=DETAIL)

#: Managed columns of each master table, in order.
MANAGED = {
    "avisos": (
        "aviso_id url primera_vez_visto ultima_vez_visto n_corridas_visto periodos_visto areas_scraping terminos_busqueda n_terminos_busqueda estado_primero estado_ultimo "
        "fecha_desactivacion_detectada dias_publicado_hasta_baja calidad_duracion censurado titulo descripcion requisitos hash_contenido empresa_id empresa_id_alt empresa_nombre "
        "empresa_confidencial fecha_publicacion fecha_expiracion vigencia_declarada_dias tipo_cargo area_funcional vacantes region comuna direccion codigo_postal latitud longitud jornada "
        "modalidad tipo_contrato sueldo_liquido muestra_sueldo moneda exp_operador exp_anios exp_inconsistente nivel_academico situacion_academica n_entradas_declaradas n_habilidades "
        "n_instituciones hash_entradas n_avisos_mismo_conjunto postulaciones visualizaciones destacada inclusiva tipo_curriculum usa_score_screening sies_por_termino n_sies_por_termino "
        "areas_sies_por_termino n_terminos_sin_mapeo detalle_ok detalle_motivo"
    ).split(),
    "aviso_entrada": "aviso_id entrada_trabajando termino_busqueda fuente n_entradas_declaradas_aviso".split(),
    "aviso_termino": "aviso_id termino_busqueda carrera_sies areas_sies mapeado".split(),
    "aviso_habilidad": "aviso_id habilidad nivel".split(),
    "aviso_institucion": "aviso_id id_institucion n_entradas_declaradas_aviso".split(),
    "aviso_programa": (
        "aviso_id tipo_entrada programa_propio area_sies isced_amplio_cod isced_estrecho_cod isced_detallado_cod n_entradas_origen entradas_origen atribucion_multiple n_entradas_declaradas_aviso"
    ).split(),
    "empresas": "empresa_id empresa_nombre nombres_observados siempre_confidencial n_avisos n_avisos_confidenciales primera_vez_visto ultima_vez_visto areas".split(),
    "entradas_trabajando": "entrada_trabajando n_avisos_acum n_avisos_especificos primera_vez_visto ultima_vez_visto areas_observadas".split(),
    "instituciones": "id_institucion id_institucion_alt nombre n_avisos n_avisos_especificos primera_vez_visto ultima_vez_visto".split(),
}
#: Tables whose unknown columns are edited by hand and kept.
MANUAL = {"empresas": "empresa_id", "entradas_trabajando": "entrada_trabajando", "instituciones": "id_institucion"}
